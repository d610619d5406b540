"""Equi-joins on report ids, coverage and backfill.

No side is broadcast by hint: Spark broadcasts a side when its measured size allows it, and
its skew handling splits a heavy key of a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_per_key


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def assign_split(
    df: DataFrame, splits: DataFrame, key: str, order: Sequence[str] = ("tr", "val", "test")
) -> DataFrame:
    """Label rows with their split; the first split in ``order`` wins, rows in none are dropped."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    one = (
        splits.withColumn("_p", place)
        .filter(F.col("_p") > 0)
        .groupBy(key)
        .agg(F.min("_p").alias("_p"))
        .select(key, F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_p").cast("int")).alias("split"))
    )
    return df.join(one, key, "inner")


def backfill_column(df: DataFrame, reference: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a missing column value from a reference table with one row per key."""
    ref = reference.select(key, F.col(column).alias("_ref"))
    joined = df.join(ref, key, "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("_ref"))).drop("_ref")


def missing_ids(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a row in ``found``."""
    return expected.join(found.select(*keys), list(keys), "left_anti")


def coverage_check(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row: number of rows of ``df`` the reference does not cover."""
    lost = df.join(reference.select(key), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("n_missing")).withColumn(
        "covered", (F.col("n_missing") == 0).cast("int")
    )


def inner_dedup_join(
    left: DataFrame, right: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """Inner join after reducing the right side to one row per key."""
    return left.join(first_per_key(right, [key], order), key, "inner")


def backfill_missing(
    predictions: DataFrame,
    expected: DataFrame,
    group: Sequence[str],
    key: str,
    label: str,
    prompt: str,
    order: Sequence[str],
    code: int = -2,
    prediction: str = "severity_pred",
) -> DataFrame:
    """Complete every (group, prompt) that occurs: a missing id gets the failed code.

    ``expected`` lists (group, key, label). Each occurring prompt is joined to
    the expected ids of its group by the group's columns.
    """
    once = first_per_key(predictions, [*group, prompt, key], order)
    prompts = predictions.groupBy(*group).agg(F.collect_set(prompt).alias("_prompts"))
    wanted = (
        expected.join(prompts, list(group), "inner")
        .withColumn(prompt, F.explode("_prompts"))
        .drop("_prompts")
    )
    lost = missing_ids(wanted, once, [*group, prompt, key])
    added = lost.select(*group, prompt, key, label, F.lit(code).alias(prediction))
    return once.unionByName(added, allowMissingColumns=True)


def label_grid(df: DataFrame, true: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """All ordered pairs of the labels seen in either column, per group.

    The label set is the domain of a classifier, so it fits one array; two explodes
    replace a cross join.
    """
    seen = df.groupBy(*group).agg(
        F.array_union(F.collect_set(true), F.collect_set(pred)).alias("_labels")
    )
    return (
        seen.withColumn("true_label", F.explode("_labels"))
        .withColumn("pred_label", F.explode("_labels"))
        .drop("_labels")
    )
