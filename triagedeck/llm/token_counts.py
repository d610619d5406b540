"""Token counts from a digest cache: only contents never counted before are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_folder, materialise
from .base import lower_ascii, query, rows_of, table, utf8
from .tokens import encoder, file_version

LIMIT = 2048
CACHE = "version string, digest binary, n_tokens long"


def content_digest(text: Column, specials: list[str]) -> Column:
    """Digest of what the tokenizer sees.

    White space runs become a blank and A-Z lower case, as the tokenizer does itself, unless a
    special string may be in the text, whose spelling counts.
    """
    norm = lower_ascii(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    exact = F.lit(False)
    for s in specials:
        exact = exact | F.contains(F.lower(text), F.lit(s.lower()))
    return F.unhex(F.sha2(F.when(exact, F.concat(F.lit("\x00"), text)).otherwise(norm), 256))


def _count(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).encode
        for batch in rows_of(batches):
            sizes = [len(encode(x)) // 4 for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([version] * len(sizes), pa.string()),
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                ],
                ["version", "digest", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` of each row.

    ``tokenizer`` is the file of a lower-casing vocabulary that drops white space. ``cache`` is a
    Parquet folder shared by all executors: counts by (tokenizer version, content digest). Contents
    are looked up there, one row of each content that misses is encoded, and its count appended.
    A run that fails before the append leaves the cache as it was; contents appended twice by
    runs at the same time are read once.

    Missing texts count as empty: 0 bytes, 0 tokens. Every row returns, repeated ids included.
    """
    spark = docs.sparkSession
    version = file_version(tokenizer)
    specials = encoder(tokenizer, True).specials
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    whole = docs.select(F.col(id_col).alias("doc_id"), text).withColumn(
        "digest", content_digest(F.col("_text"), specials)
    )
    seen = materialise(
        whole.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), "digest"),
        "digests",
    )
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    misses = (
        seen.groupBy("digest")
        .agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).getField("doc_id").alias("_rep"))
        .join(known, "digest", "left_anti")
    )
    # one row per content, or a few where rows repeat an id with its content; one count is appended
    chosen = whole.alias("w").join(
        misses.hint("shuffle_hash").alias("m"),
        F.col("w.doc_id").eqNullSafe(F.col("m._rep")) & (F.col("w.digest") == F.col("m.digest")),
        "left_semi",
    )
    counted = chosen.select("digest", "_text").mapInArrow(_count(tokenizer, version), CACHE)
    counted.dropDuplicates(["version", "digest"]).write.mode("append").parquet(cache)
    counts = materialise(
        spark.read.schema(CACHE)
        .parquet(cache)
        .filter(F.col("version") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens")),
        "counts",
    )
    return seen.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


@query("op9_token_counts")
def op9(spark, sf):
    import public_tokenizers

    return token_counts(
        table(spark, sf, "documents").select("doc_id", "text"),
        public_tokenizers.path("word_bpe_49k.json"),
        fresh_folder(spark, "token_cache"),
    )
