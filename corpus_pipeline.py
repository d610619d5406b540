"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagedeck.llm.base import in_order
from triagedeck.llm.line_dedup import line_dedup
from triagedeck.llm.mixing import mix_sources, repeat_documents
from triagedeck.llm.near_dedup import near_duplicates
from triagedeck.llm.packing import pack_documents
from triagedeck.llm.quality import THRESHOLD, quality_model, quality_scores
from triagedeck.session import materialise

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


OWN = ("doc_id", "text", "source")
SHINGLE_WORDS = 4  # as in the operator's own query


def _packed(docs: DataFrame) -> DataFrame:
    """Only the columns the stages work on, the others by number in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in OWN]
    return docs.select(*OWN, F.struct(*rest, F.lit(True).alias("last")).alias("rest"))


def _unpacked(docs: DataFrame, columns: list[str], resized: bool = True) -> DataFrame:
    """The columns of the stage's input, with ``n_chars``, if there, that of the present text."""
    out = []
    for i, c in enumerate(columns):
        value = F.col(c) if c in OWN else F.col("rest").getField(f"c{i}")
        out.append((F.char_length("text").cast("long") if c == "n_chars" and resized else value).alias(c))
    return docs.select(*out)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the threshold; the classifier learns from these documents.

    A missing text scores as an empty one; repeated rows score alike. Columns stay as they are.
    """
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(_packed(docs), model, out="quality")
    return _unpacked(scored.filter(F.col("quality") >= THRESHOLD), docs.columns, resized=False)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three documents share, except in the largest id; missing texts become empty.

    Rows with the same id count as one document. Other columns stay as they are.
    """
    return _unpacked(line_dedup(_packed(docs)), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates.

    Where ids are missing or repeated, rows are numbered by id (missing last) and text, and one row of each
    group stays, repeated rows included. Texts without words belong to no group.
    """
    rows = _packed(docs)
    unclear = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if unclear.isEmpty():
        rows = rows.withColumn("pos", F.col("doc_id"))
    else:
        rows = in_order(rows, F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), name="numbered")
    found = near_duplicates(rows.select(F.col("pos").alias("doc_id"), "text"), n_words=SHINGLE_WORDS)
    gone = found.filter("not kept").select(F.col("doc_id").alias("pos"))
    return _unpacked(rows.join(gone, "pos", "left_anti"), docs.columns, resized=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or cut documents so that each source comes to its target. Other columns are repeated with them."""
    rows = _packed(docs)
    return _unpacked(repeat_documents(rows, mix_sources(rows)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mix", mix),
    ("pack", pack_sequences),
]
#: The classifier and the tokenizer cannot be written in SQL; the tests check the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
