"""Ranks and running totals that never sort a whole group in one task.

``row_number().over(partitionBy(label))`` puts every row of a label into one
task, and a global window puts the whole table there. Both are avoided by cutting the order
key into ranges: rows are counted per (group, range), the small count table is
accumulated into offsets, and the window only runs inside one (group, range).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

RANGES_PER_PARTITION = 4  # ranges of an order for each shuffle partition, so that they even out


def n_ranges(spark: SparkSession) -> int:
    """Ranges an order is cut into: they follow the shuffle partitions, which are set for the data at hand."""
    return RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_digits(spark: SparkSession) -> int:
    """Leading hexadecimal digits of a hash that make at least so many ranges."""
    digits = 1
    while 16**digits < n_ranges(spark):
        digits += 1
    return digits


def hash_order(seed: Column | str | int, *keys: str | Column) -> Column:
    """Seeded pseudo-random order key, equal in every engine that has md5."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [first.cast("string")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_uniform(key: Column) -> Column:
    """Hash order key -> double in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def place(keys: Sequence[str]) -> Column:
    """Key columns as one value: never null itself, and equal where its nulls are equal.

    Joining and windowing on the same value needs a single shuffle, nulls included.
    """
    return F.struct(*keys)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, keeping the left key columns."""
    extra = [c for c in small.columns if c not in keys]
    return (
        df.withColumn("_at", place(keys))
        .join(small.select(place(keys).alias("_at"), *extra), "_at")
        .drop("_at")
    )


def shuffled_rank(
    df: DataFrame,
    key: str,
    seed: Column | str | int,
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    limit: Column | int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """1-based rank in seeded random order, per group if one is given.

    ``key`` identifies a row within its group. ``total`` names an optional
    column with the group size. With ``limit``, ranks above it are not
    returned, and hash ranges that lie wholly above it are dropped before the shuffle.
    """
    group = list(group)
    digits = digits or hash_digits(df.sparkSession)
    keyed = df.withColumn("_h", hash_order(seed, key)).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*(group or [F.lit(0)]))
    before = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        place([*group, "_b"]).alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(part).alias("_total"),
    )
    placed = keyed.withColumn("_at", place([*group, "_b"])).join(offsets, "_at")
    if limit is not None:
        placed = placed.filter(F.col("_off") < limit)
    inside = Window.partitionBy("_at").orderBy("_h", key)
    ranked = placed.withColumn(
        rank, (F.row_number().over(inside) + F.col("_off")).cast("long")
    )
    if limit is not None:
        ranked = ranked.filter(F.col(rank) <= limit)
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_at", "_h", "_b", "_off", "_total")


def range_limits(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    """Approximate quantiles of ``col`` that cut it into about ``parts`` ranges.

    Only the balance of the work depends on their accuracy, never a result.
    """
    parts = max(2, parts or n_ranges(df.sparkSession))
    probs = [i / parts for i in range(1, parts)]
    cuts = df.select(F.col(col).cast("double").alias("_v")).approxQuantile(
        "_v", probs, 1.0 / (4 * parts)
    )
    return sorted(set(cuts))


def add_range(df: DataFrame, col: str, cuts: Sequence[float], out: str = "_b") -> DataFrame:
    """Number of the range that holds ``col`` (monotone in ``col``)."""
    work = df.withColumn("_v", F.col(col).cast("double"))
    stage = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_v",
        outputCol="_d",
        handleInvalid="keep",
    )
    if not cuts:
        return df.withColumn(out, F.lit(0))
    return (
        stage.transform(work).withColumn(out, F.col("_d").cast("int")).drop("_v", "_d")
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column | str],
    group: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` along a numeric order column.

    Rows must be unique per (group, order): aggregate them first. The ranges
    are literals in the plan, so a re-run task always sees the same ones.
    ``totals`` names columns for the whole sums of the group: {running sum: column}. They travel
    with the offsets, so no join on the group gathers a large one in a task.
    """
    group = list(group)
    if cuts is None:
        cuts = range_limits(df, order)
    cut = add_range(df, order, cuts)
    named = {name: (F.col(c) if isinstance(c, str) else c) for name, c in sums.items()}
    sub = cut.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in named.items()])
    way = F.desc("_b") if descending else F.asc("_b")
    before = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(way)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    offsets = sub.select(
        place([*group, "_b"]).alias("_at"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in named],
        *[F.sum(f"_s_{n}").over(whole).alias(out) for n, out in (totals or {}).items()],
    )
    placed = cut.withColumn("_at", place([*group, "_b"])).join(offsets, "_at")
    col = F.desc(order) if descending else F.asc(order)
    inside = (
        Window.partitionBy("_at")
        .orderBy(col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = placed.withColumns(
        {n: F.sum(c).over(inside) + F.col(f"_o_{n}") for n, c in named.items()}
    )
    return added.drop("_at", "_b", *[f"_o_{n}" for n in named])


def ordered_rank(
    df: DataFrame,
    order: str,
    group: Sequence[str] = (),
    rank: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """1-based position along a numeric key that is unique within its group."""
    return running_totals(df, order, {rank: F.lit(1)}, group, descending)


def value_table(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, _q, _n): rows per distinct value, written once.

    Missing values are dropped after the write: as a filter on the rows, the
    test would compute a derived column a second time.
    """
    counted = df.groupBy(*group, F.col(col).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(counted, "values").filter(F.col("_q").isNotNull())


def exact_quantiles(
    counts: DataFrame, probs: Mapping[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named probability.

    Works on a ``value_table``, so neither a heavy value nor a wide value range
    gathers in one task.
    """
    group = list(group)
    both = running_totals(counts, "_q", {"_c": "_n"}, group, totals={"_c": "_t"})
    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_t") - 1)
        for tag, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("_c") - F.col("_n") <= at) & (at < F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_q").cast("double"))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_{name}_f"))
    picked = both.groupBy(*group).agg(*aggs)
    lo, hi, share = (lambda n, tag=tag: F.col(f"_{n}_{tag}") for tag in ("lo", "hi", "f"))
    return picked.select(
        *group, *[(lo(n) + (hi(n) - lo(n)) * share(n)).alias(n) for n in probs]
    )
