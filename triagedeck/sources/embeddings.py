"""Embedding chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.dedup import first_per_key


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet chunks ``chunk=<n>/`` as one table with the chunk number."""
    return spark.read.parquet(path)


def merge_chunks(chunks: DataFrame, key: str, chunk: str = "chunk") -> DataFrame:
    """One row per key; the earliest chunk wins."""
    return first_per_key(chunks, [key], [chunk])
