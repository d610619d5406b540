"""Registry of this subpackage's queries, and what its operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import place
from ..session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The white space of all operators: blank and the controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(1 << 63)  # stands for a missing id in orders; ids of that value sort with it


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def utf8(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a missing one is empty."""
    return [x or "" for x in column.to_pylist()]


def rows_of(
    batches: Iterator[pa.RecordBatch], step: int = 512
) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a step holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def range_cuts(df: DataFrame, col: str, rows_per_range: int) -> list[float]:
    """Limits that cut a numeric column into ranges of about so many rows.

    Their number follows the table. Only the balance of the work depends on their accuracy.
    """
    n = df.count()
    parts = -(-n // rows_per_range)
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(col, probs, 1.0 / (4 * parts))))


PLACE_BITS = 33  # monotonically_increasing_id(): the partition above, the row below


def in_order(df: DataFrame, *order: Column | str, name: str, out: str = "pos") -> DataFrame:
    """Rows written in the order of the keys, with ``out``, a number that ascends with it.

    Spark deals ranges of the keys out and sorts each, so no task holds a group. The number has gaps between
    ranges; ``range_of`` tells the range. Rows that are equal in all keys are spread too, by a
    salt that repeats when a task does.
    """
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    keys = [*order, "_salt"]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    return materialise(dealt.withColumn(out, F.monotonically_increasing_id()), name)


def range_of(pos: Column | str = "pos") -> Column:
    """Number of the range that ``in_order`` put a row into."""
    return F.shiftright(F.col(pos) if isinstance(pos, str) else pos, PLACE_BITS)


def numbered(rows: DataFrame, group: str, pos: str = "pos", out: str = "idx", total: str = "n") -> DataFrame:
    """Place of each row of ``in_order`` in its group, from 0, and the group's size.

    The order must begin with the group. Rows are counted by group and range; only these counts are
    summed up group by group.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), range_of(pos).alias("_r")).agg(
        F.min(pos).alias("_lo"), F.count(F.lit(1)).alias("_n")
    )
    part = Window.partitionBy("_g")
    before = part.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        place(["_g", "_r"]).alias("_at"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_off"),
        F.sum("_n").over(part).alias(total),
    )
    keyed = rows.withColumn("_at", F.struct(F.col(group).alias("_g"), range_of(pos).alias("_r")))
    return keyed.join(offsets, "_at").withColumn(out, F.col(pos) + F.col("_off")).drop("_at", "_off", pos)
