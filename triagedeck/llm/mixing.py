"""Mix sources to target weights: water-filling under an epoch cap, then seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import hash_order, place
from ..session import materialise
from .base import WORD, query, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 20_000  # documents of one source that are sorted together
ORDER_DIGITS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size) -> target words of each source.

    Sources ordered by code point, the missing one last, weigh ``weights``, repeating. All words
    are shared by weight; what exceeds ``max_epochs`` times a source goes to the others by weight
    until nobody is above. With sources in the order of their cap per weight, the clamped ones
    come first: at each place, the level is the words left over the weights left, and the first place
    whose cap per weight reaches its level ends the clamping. The table has one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sources.withColumn("_w", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    caps = caps.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def left(c: str, total: str) -> Column:
        return F.sum(total).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0))

    levels = caps.withColumn("_level", left("_cap", "source_size") / left("_w", "_w"))
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(whole)
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * level.getField("_level"))
    return levels.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "source", "source_size", "target"
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each document.

    One row per row of ``docs``: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` (whole repetitions), ``part`` (words of one more,
    partial repetition), ``taken`` = copies * size + part, and ``text_hash``, which tells rows that
    share an id apart.

    Each source is taken floor(target / source_size) times whole. The rest of its target is the first
    words of its documents in a seeded order: those documents get one more copy, and the last is
    cut, so a source meets its target to a word, however long its documents are. The
    order is a hash: reruns agree. A hot source is sorted in buckets of the hash, whose sums are
    added up first, so no task holds a source.

    Missing texts have size 0; sources without words have target 0; rows without a source are a
    source of their own, last in order. Rows with the same id are taken one after the other, the
    shorter first. Empty tables give empty tables.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.substring(hash_order(seed, id_col), 1, ORDER_DIGITS).alias("_h"),
            F.xxhash64(text_col).alias("text_hash"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")
    )
    largest = sources.agg(F.max("_n")).first()[0] or 0
    digits = 1
    while 16**digits * BUCKET_ROWS < largest and digits < ORDER_DIGITS - 1:
        digits += 1
    targets = source_targets(sources.drop("_n"), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("copies", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "_rest", F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")
    )
    keyed = sized.withColumn("_b", F.substring("_h", 1, digits))
    sums = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    plan = materialise(
        offsets.alias("o")
        .join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select(
            place(["o.source", "_b"]).alias("_at"), "_off", "source_size", "target", "copies", "_rest"
        ),
        "mix_plan",
    )
    inside = (
        Window.partitionBy("_at")
        .orderBy("_h", "doc_id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - start)).cast("long")
    return (
        keyed.withColumn("_at", place(["source", "_b"]))
        .join(plan, "_at")
        .withColumn("part", part)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            "part",
            "text_hash",
            (F.col("copies") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def repeat_documents(
    docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes them, the partial repetition cut to its words.

    Rows that are equal in id and text get one entry of the mix each. Columns stay as they are.
    """
    entries = mix.groupBy(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("_at")).agg(
        F.array_sort(F.collect_list(F.struct("copies", "part"))).alias("_mix")
    )
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.withColumn("_at", key)
    placed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_at").orderBy(*rest)))
    own = F.element_at("_mix", F.col("_nth"))
    taken = placed.join(entries, "_at").withColumn("_own", own)
    whole = F.array_repeat(F.col(text_col), F.col("_own.copies").cast("int"))
    part = F.when(F.col("_own.part") > 0, F.array(first_words(F.col(text_col), F.col("_own.part"))))
    texts = F.concat(whole, F.coalesce(part, F.array().cast("array<string>")))
    return taken.withColumn("_text", F.explode(texts)).select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )


MIX_SQL = """{p}sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5('mix|' || doc_id), 1, 8) AS h FROM {docs}),
{p}src AS (SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM {p}sized GROUP BY source),
{p}lev AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev FROM {p}src
  WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}tgt AS (SELECT source, source_size,
    coalesce(least(cap::DOUBLE, w * (SELECT min_by(lev, ratio) FROM {p}lev WHERE ratio >= lev)), 0) AS target FROM {p}lev),
{p}mix AS (SELECT doc_id, s.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM {p}sized s JOIN {p}tgt t ON s.source IS NOT DISTINCT FROM t.source),
{p}taken AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - copies * source_size - start)) AS part FROM {p}mix)"""


@query(
    "op3_mix_sources",
    "WITH "
    + MIX_SQL.format(p="", docs="documents")
    + " SELECT doc_id, size, source_size, target, (copies * size + part)::BIGINT AS taken FROM taken",
)
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
