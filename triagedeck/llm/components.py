"""Connected components of links between numbered classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``; written, so that a join on a hot ``u`` can be split."""
    return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def components(links: DataFrame) -> DataFrame:
    """(``a``, ``b``) links -> (``node``, ``root``), the smallest number reachable, for each linked node.

    Every round points the larger neighbours of a node at the smallest one around it, then the
    node and its smaller neighbours at the smallest of these, until nothing changes: what is left
    is one star per component. A round's links are written and replace the last one's. No links
    give an empty table.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialise(pairs.distinct(), "links")
    seen = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()
            )
        seen = state
        both = materialise(now.union(now.select("v", "u")), "both_ways")
        low = _lowest(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "larger")
        small = large.join(_lowest(large), "u")
        now = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            "links",
        )
