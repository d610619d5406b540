"""One row per key, top rows, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ``order`` per key.

    An aggregate rather than a window: each map task already reduces its copies of a key
    to one row, so a key that holds much of the table is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    kept = df.groupBy(*keys).agg(best)
    return kept.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def has_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: is any key repeated, and by how many surplus rows. Texts are shuffled as 256-bit digests."""
    texts = {name for name, kind in df.dtypes if kind == "string"}
    short = [F.unhex(F.sha2(F.col(k), 256)).alias(k) if k in texts else F.col(k) for k in keys]
    per_key = df.groupBy(*short).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.max((F.col("n") > 1).cast("int")), F.lit(0)).alias("has_duplicates"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rn"
) -> DataFrame:
    """First ``n`` rows of each group; Spark limits each map task to ``n`` per group first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def best_per_group(
    df: DataFrame, group: Sequence[str], metric: str, tie: str
) -> DataFrame:
    """Row with the largest metric per group; the smallest ``tie`` wins a tie."""
    rest = [c for c in df.columns if c not in group]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(metric), F.col(tie))).alias("_row")
    kept = df.filter(F.col(metric).isNotNull()).groupBy(*group).agg(best)
    return kept.select(*group, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an ordered table."""
    return df.orderBy(*order).limit(n)
