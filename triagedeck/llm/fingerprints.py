"""Document fingerprints: the shingle hashes below a fixed fraction, in SQL functions only.

Half of all hash values are kept, at every length of text alike. The likeness of a text of n words to another then errs by
about 0.11 below 30 words, 0.07 below 60 and 0.05 below 150 (root mean square), and by less beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import add_range, n_ranges, range_limits
from .base import NO_ID, query, table

SHINGLE = 5
FRACTION = 0.5  # of all hash values that are kept
LOWEST = -(1 << 63)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the runs of ``n`` words; fewer words are one run, no words none."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        # the hash passes over the missing words beyond the end of a short text
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) > 0, hashed).otherwise(F.array().cast("array<bigint>"))

    # a one-element array binds the words once
    return F.element_at(F.transform(F.array(words), runs), 1)


def fingerprint(text: Column, fraction: float = FRACTION, n: int = SHINGLE) -> Column:
    """Sorted distinct hashes below the fraction, and always the smallest.

    Two fingerprints merge by uniting them and dropping a smallest hash that the other's undercuts.
    Texts without words have none.
    """
    limit = F.lit(min(LOWEST + int(fraction * 2**64), -LOWEST - 1)).cast("long")

    def kept(h: Column) -> Column:
        low = F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))
        return F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < limit), low)))

    return F.element_at(F.transform(F.array(shingle_hashes(text, n)), kept), 1)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints; equal ones have 1, also if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first's shingles that the second holds; nothing is wholly contained."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), ",")


def with_next(docs: DataFrame, id_col: str, columns: list[str], order: list[str]) -> DataFrame:
    """Add ``_next``: a struct of ``columns`` of the next row by descending id, the first row's for the last.

    Rows are dealt out by ranges of the id, four for each shuffle partition whatever the table. The first
    rows of every range are copied to the end of the nearest range above, so each range is put in
    order alone and a text moves once; the range heads that are broadcast are as many as the ranges.
    Rows with the same id are ordered by ``order``. Rows without an id come last, by the hash of those
    columns, which cuts them into as many ranges again, however many they are.
    """
    parts = n_ranges(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    keyed = docs.withColumn("_k", key).withColumn(
        "_h", F.when(F.col("_k") == NO_ID, F.xxhash64(*order)).otherwise(F.lit(0).cast("long"))
    )
    cuts = range_limits(keyed.select("_k").filter(F.col("_k") != NO_ID), "_k")
    below = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    keyed = add_range(keyed, "_k", cuts, "_range").withColumn(
        "_range", F.when(F.col("_k") == NO_ID, -1 - below).otherwise(F.col("_range"))
    )
    # one row per range; their number is bounded by the setting of the shuffle partitions
    tops = keyed.groupBy("_range").agg(F.max("_k").alias("_top"), F.min("_h").alias("_low"))
    above = F.lead("_range").over(Window.orderBy("_range"))
    highest = F.first("_range").over(Window.orderBy("_range"))
    tops = tops.select(F.col("_range").alias("_of"), "_top", "_low", F.coalesce(above, highest).alias("_to"))
    first = (F.col("_range") == F.col("_of")) & (F.col("_k") == F.col("_top")) & (F.col("_h") == F.col("_low"))
    copies = (
        keyed.join(F.broadcast(tops), first)
        .withColumn("_range", F.col("_to"))
        .withColumn("_copy", F.lit(True))
        .drop("_of", "_top", "_low", "_to")
    )
    dealt = keyed.withColumn("_copy", F.lit(False)).unionByName(copies)
    inside = Window.partitionBy("_range").orderBy("_copy", F.desc("_k"), "_h", *order)
    return (
        dealt.withColumn("_next", F.lead(F.struct(*columns)).over(inside))
        .filter(~F.col("_copy"))
        .drop("_k", "_h", "_range", "_copy")
    )


def next_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``fingerprint`` (hashes), ``edited``, ``edited_fingerprint``, ``next_fingerprint``.

    A text is edited by putting the first floor(n/3) code points of the next document, by
    descending id, in the place of its last floor(n/3). Missing texts are empty. Rows with the
    same id follow each other by text, rows without one by its hash; a single row is its own next one.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # only texts move; all hashes would be longer than they
    paired = with_next(texts, "doc_id", ["text"], ["text"]).withColumn("hashes", fingerprint(F.col("text")))
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - third),
        F.substring(F.col("_next.text"), F.lit(1), third),
    )
    return (
        paired.withColumn("edited", edited)
        .withColumn("edited_hashes", fingerprint(F.col("edited")))
        .withColumn("next_hashes", fingerprint(F.col("_next.text")))
        .drop("_next")
    )


@query("op6_fingerprints")
def op6(spark, sf):
    d = next_edits(table(spark, sf, "documents").select("doc_id", "text"))
    own, edited, following = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return d.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"),
        resemblance(own, following).alias("near_next"),
        containment(own, edited).alias("contained_edited"),
        containment(own, following).alias("contained_next"),
    )
