"""Confusion matrices, per-class scores, coverage and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import label_grid
from .dedup import top_per_group
from .ranks import attach, exact_quantiles, value_table


def ratio(num: Column, den: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def cell_counts(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(
        *group, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Long-form matrix over the union of seen labels, zero-filled.

    The rows are counted once; the grid is built from the counts.
    """
    cells = cell_counts(df, true, pred, group)
    grid = label_grid(cells, "true_label", "pred_label", group)
    keys = [*group, "true_label", "pred_label"]
    return grid.join(cells, keys, "left").fillna(0, subset=["n"])


def confusion_totals(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Matrix cells, row and column totals and the corner, each with its percentage.

    A cell shows its share of all rows, a total the share of its correct rows.
    """
    cells = cell_counts(df, true, pred).withColumn(
        "hit", F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    )
    cube = cells.cube("true_label", "pred_label").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("n"),
        F.sum("hit").alias("n_correct"),
    )
    total = cells.agg(F.sum("n").alias("t")).scalar()
    num = F.when(F.col("level") == 0, F.col("n")).otherwise(F.col("n_correct"))
    den = F.when(F.col("level") == 0, total).otherwise(F.col("n"))
    return cube.withColumn("pct", ratio(F.lit(100) * num, den))


def class_scores(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label; 0 where undefined."""
    cells = cell_counts(df, true, pred, group)
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    sums = (
        cells.select(*group, F.inline(sides))
        .groupBy(*group, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    return sums.select(
        *group,
        "label",
        "support",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def f1_averages(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted F1."""
    scores = class_scores(df, true, pred, group)
    return scores.groupBy(*group).agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def accuracy(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Share of equal codes; failed and undecided answers count as wrong."""
    right = F.coalesce((F.col(true) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.groupBy(*group).agg(
        F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def percent_of_group(counts: DataFrame, n: str, group: Sequence[str]) -> DataFrame:
    """Whole percent of the group total, halves to even. Takes an already counted table."""
    total = F.sum(n).over(Window.partitionBy(*group))
    return counts.withColumn("pct", F.bround(F.lit(100.0) * F.col(n) / total, 0))


def representatives(
    df: DataFrame, true: str, pred: str, key: str, n: int, payload: Sequence[str]
) -> DataFrame:
    """Up to ``n`` rows, in key order, of every (true, predicted) pair; empty pairs too."""
    first = top_per_group(df, [true, pred], [F.asc(key)], n)
    picked = first.groupBy(
        F.col(true).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(F.sort_array(F.collect_list(F.struct(key, *payload))).alias("samples"))
    grid = label_grid(cell_counts(df, true, pred), "true_label", "pred_label")
    return grid.join(picked, ["true_label", "pred_label"], "left").withColumn(
        "samples", F.coalesce("samples", F.array())
    )


def describe(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum.

    The rows are read once, for a table of distinct values; all the figures come from it.
    """
    group = list(group)
    values = value_table(df, col, group)
    x, n = F.col("_q").cast("double"), F.col("_n")
    basic = values.groupBy(*group).agg(
        F.sum(n).alias("count"),
        (F.sum(n * x) / F.sum(n)).alias("mean"),
        F.min("_q").alias("min"),
        F.max("_q").alias("max"),
    )
    quartiles = exact_quantiles(values, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, group)

    def spread(centred: DataFrame) -> DataFrame:
        gap = x - F.col("mean")
        return centred.groupBy(*group).agg(
            F.sqrt(F.try_divide(F.sum(n * gap * gap), F.sum(n) - 1)).alias("std")
        )

    if group:
        std = spread(attach(values, basic.select(*group, "mean"), group))
        found = attach(attach(basic, std, group), quartiles, group)
    else:
        std = spread(values.withColumn("mean", basic.select("mean").scalar()))
        row = quartiles.select(F.struct("q25", "q50", "q75").alias("q"))
        found = (
            basic.withColumn("std", std.scalar()).withColumn("q", row.scalar()).select("*", "q.*")
        )
    return found.select(*group, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, type, non-null count, has nulls) from one aggregation."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).alias("n_non_null"),
                (F.col(c) < F.col("_rows")).cast("int").alias("has_null"),
            )
            for c in df.columns
        ]
    )
    return counted.select(F.inline(cells))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *[F.asc_nulls_first(c) for c in cols])
    )


def coverage_table(
    rows: DataFrame, totals: DataFrame, dataset: str, split: str, splits: Sequence[str]
) -> DataFrame:
    """Rows per split and whole percent of the dataset, one wide row per dataset."""
    counted = rows.groupBy(dataset).pivot(split, list(splits)).agg(F.count(F.lit(1)))
    wide = counted.join(totals, dataset, "left")
    out = [F.col(dataset), F.col("n_total")]
    for s in splits:
        n = F.coalesce(F.col(s), F.lit(0))
        out += [n.alias(f"n_{s}"), F.bround(F.lit(100.0) * n / F.col("n_total"), 0).alias(f"pct_{s}")]
    return wide.select(*out)


def mean_matrix(df: DataFrame, matrix: str, group: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of nested arrays: (row, column, mean)."""
    rows = df.select(*group, F.posexplode(matrix).alias("row", "_cells"))
    cells = rows.select(*group, "row", F.posexplode("_cells").alias("col", "_v"))
    return cells.groupBy(*group, "row", "col").agg(F.avg("_v").alias("mean"))


def pooled(states: str, how: str = "mean") -> Column:
    """Token x dimension array -> one vector: mean, sum or that of the first token."""
    first = F.element_at(F.col(states), 1)
    if how == "first":
        return F.transform(first, lambda x: x.cast("double"))
    zero = F.transform(first, lambda x: F.lit(0.0))
    n = F.size(states).cast("double") if how == "mean" else F.lit(1.0)
    return F.aggregate(
        F.col(states),
        zero,
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
        lambda acc: F.transform(acc, lambda a: a / n),
    )


def pool_vectors(
    df: DataFrame, key: str, states: str, how: str = "mean"
) -> DataFrame:
    """Pooled vectors in long form. A row's own array is folded in place, no shuffle."""
    return df.select(key, F.posexplode(pooled(states, how)).alias("dim", "value"))


def vector_min_max(df: DataFrame, vector: str) -> DataFrame:
    """Smallest and largest value of every dimension."""
    cells = df.select(F.posexplode(vector).alias("dim", "_v"))
    return cells.groupBy("dim").agg(
        F.min("_v").cast("double").alias("min"), F.max("_v").cast("double").alias("max")
    )
