"""Splits, folds, samples and chunks; every random choice is a seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import hash_order, ordered_rank, shuffled_rank


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    parts: Sequence[int] = (7, 2, 1),
    seed: int | str = 0,
    out: str = "split",
) -> DataFrame:
    """Train / validation / test per class, in integer arithmetic.

    The first share of each class goes to ``tr``; the rest is divided between ``val`` and ``test``.
    """
    a, b, c = parts
    ranked = shuffled_rank(df, key, seed, [label], rank="_rank", total="_n")
    ranked = ranked.withColumn("_tr", F.expr(f"({a} * _n) div {a + b + c}")).withColumn(
        "_val", F.expr(f"({b} * (_n - _tr)) div {b + c}")
    )
    part = (
        F.when(F.col("_rank") <= F.col("_tr"), "tr")
        .when(F.col("_rank") <= F.col("_tr") + F.col("_val"), "val")
        .otherwise("test")
    )
    return ranked.withColumn(out, part).drop("_rank", "_n", "_tr", "_val")


def shuffle_split(
    df: DataFrame, key: str, label: str, test_percent: int = 20, seed: int | str = 0
) -> DataFrame:
    """One stratified split into train and test."""
    ranked = shuffled_rank(df, key, seed, [label], rank="_rank", total="_n")
    n_test = F.expr(f"({test_percent} * _n) div 100")
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= n_test, "test").otherwise("tr")
    ).drop("_rank", "_n")


def stratified_kfold(
    df: DataFrame, key: str, label: str, k: int, seeds: Sequence[int]
) -> DataFrame:
    """Fold number of every row for every seed."""
    many = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    ranked = shuffled_rank(many, key, F.col("seed"), ["seed", label], rank="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def balanced_sample(df: DataFrame, key: str, label: str, epochs: Sequence[int]) -> DataFrame:
    """Per epoch all rows of the smaller class and as many of each other, drawn anew."""
    smallest = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.min("_n").alias("_m"))
        .scalar()
    )
    many = df.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    return shuffled_rank(
        many, key, F.col("epoch"), ["epoch", label], rank="draw", limit=smallest
    )


def sample_ladder(
    df: DataFrame, key: str, sizes: Sequence[int], seed: int | str = 0
) -> DataFrame:
    """First n rows of one shuffled list for each n; -1 stands for all rows."""
    ranked = shuffled_rank(df, key, seed, rank="_rank")
    steps = F.array(*[F.lit(int(s)) for s in sizes])
    fits = F.filter(steps, lambda s: (s == -1) | (s >= F.col("_rank")))
    return ranked.withColumn("n_samples", F.explode(fits)).drop("_rank")


def chunk_ranges(df: DataFrame, key: str, n_chunks: int) -> DataFrame:
    """Contiguous chunks along the key: (chunk, start, end); the last takes the remainder."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ordered_rank(df.select(key), key, rank="_rank").withColumn("_n", total)
    width = F.greatest(F.expr(f"_n div {n_chunks}"), F.lit(1))
    chunk = F.least(
        F.floor((F.col("_rank") - 1) / width), F.lit(n_chunks - 1)
    ).cast("int")
    return (
        ranked.withColumn("chunk", chunk)
        .groupBy("chunk")
        .agg(
            (F.min("_rank") - 1).alias("start"),
            F.max("_rank").alias("end"),
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
        )
    )


def fixed_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """Consecutive groups of ``size`` keys; the last may be short."""
    ranked = ordered_rank(df.select(key), key, rank="_rank")
    numbered = ranked.withColumn("group_id", F.expr(f"(_rank - 1) div {size}"))
    return numbered.groupBy("group_id").agg(
        F.sort_array(F.collect_list(key)).alias("members"),
        F.count(F.lit(1)).alias("n_members"),
    )


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight of the positive class: negatives per positive."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    ).withColumn(
        "pos_weight", F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive"))
    )


def parameter_grid(df: DataFrame, choices: dict[str, Sequence]) -> DataFrame:
    """Every combination of the choices for every row of ``df`` (a table of studies)."""
    grid = df
    for name, values in choices.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def grid_sample(grid: DataFrame, study: Sequence[str], names: Sequence[str], n: int, seed=0) -> DataFrame:
    """``n`` random combinations of each study's grid."""
    order = hash_order(seed, *study, *names)
    w = Window.partitionBy(*study).orderBy("_h")
    return (
        grid.withColumn("_h", order)
        .withColumn("draw", F.row_number().over(w))
        .filter(F.col("draw") <= n)
        .drop("_h")
    )


def few_shot_picks(
    df: DataFrame, key: str, label: str, text: str, max_chars: int = 250
) -> DataFrame:
    """Smallest key of each class among the texts shorter than ``max_chars``."""
    short = df.filter(F.length(text) < max_chars)
    return short.groupBy(label).agg(
        F.min(key).alias(key), F.min_by(text, key).alias(text)
    )


def few_shot_block(
    df: DataFrame, template: Column, key: str, label: str, text: str, max_chars: int = 250
) -> tuple[DataFrame, DataFrame]:
    """The filled example block (one row) and the data without the chosen rows."""
    picks = few_shot_picks(df, key, label, text, max_chars)
    wide = picks.agg(
        F.max(F.when(F.col(label) == 1, F.col(text))).alias("severe_descr"),
        F.max(F.when(F.col(label) == 0, F.col(text))).alias("non_severe_descr"),
        F.max(F.when(F.col(label) == 1, F.col(key))).alias("severe_key"),
        F.max(F.when(F.col(label) == 0, F.col(key))).alias("non_severe_key"),
    )
    block = wide.withColumn("examples", template)
    return block, df.join(picks.select(key), key, "left_anti")
