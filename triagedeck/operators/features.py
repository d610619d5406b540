"""Bag-of-words, TF-IDF and scaling in long form (key, term, value).

The long form holds any vocabulary: nothing is dropped, nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def term_counts(df: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, term, n). A text lies in one task, so the counts are final before the shuffle.

    ``keep`` names columns that depend on the key, such as label and split.
    """
    exploded = df.select(key, *keep, F.explode(tx.terms(F.col(text))).alias("term"))
    return exploded.groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("n"))


def binary_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n", F.lit(1).cast("long"))


def vocabulary(train_counts: DataFrame) -> DataFrame:
    """Document frequency, total and range of every training term."""
    return train_counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("n").alias("total"),
        F.min("n").alias("n_min"),
        F.max("n").alias("n_max"),
    )


def vocabulary_size(train_counts: DataFrame) -> DataFrame:
    """One row: number of terms and the alphabetically first one."""
    terms = train_counts.select("term").distinct()
    return terms.agg(F.count("term").alias("n_terms"), F.min("term").alias("first_term"))


def tfidf(
    counts: DataFrame, train_counts: DataFrame, n_train: Column, key: str
) -> DataFrame:
    """Smoothed TF-IDF with rows of unit length; terms unseen in training are ignored."""
    idf = F.log((F.lit(1.0) + n_train) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    weights = train_counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = weights.withColumn("idf", idf).select("term", "idf")
    raw = counts.join(weights, "term").withColumn("_v", F.col("n") * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_len"))
    return raw.join(norms, key).select(key, "term", (F.col("_v") / F.col("_len")).alias("tfidf"))


def fit_term_range(train_counts: DataFrame, n_train: Column) -> DataFrame:
    """(term, lo, hi, absent): training range, zeros included.

    ``absent`` is the scaled value of a text without the term. It differs from 0 only for a
    term that every training text has.
    """
    stats = vocabulary(train_counts).withColumn(
        "lo", F.when(F.col("df") < n_train, F.lit(0)).otherwise(F.col("n_min"))
    )
    span = F.col("n_max") - F.col("lo")
    return stats.select(
        "term",
        "lo",
        F.col("n_max").alias("hi"),
        F.when(span == 0, F.lit(0.0)).otherwise(-F.col("lo") / span).alias("absent"),
    )


def scale_terms(counts: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Min-max scaled term values without clipping; a constant term gives 0."""
    span = F.col("hi") - F.col("lo")
    x = F.when(span == 0, F.lit(0.0)).otherwise((F.col("n") - F.col("lo")) / span)
    return counts.join(ranges, "term").select(key, "term", x.alias("x"), "absent")


def fit_vector_range(df: DataFrame, vector: str) -> DataFrame:
    """One row (lo, hi): arrays with the range of every dimension."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    found = df.select(Summarizer.metrics("min", "max").summary(dense).alias("s"))
    return found.select(
        F.struct(
            vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")
        ).alias("r")
    )


def guard_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Return ``df`` unchanged, or fail when its vectors differ in width or hold NaN or null; one pass."""
    missing = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    row = df.agg(
        F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count_if(missing).alias("bad")
    ).first()
    if row["lo"] != row["hi"] or row["bad"]:
        raise ValueError(f"vectors of {row['lo']} to {row['hi']} values, {row['bad']} with missing ones")
    return df


def scale_vectors(df: DataFrame, vector: str, train: DataFrame, out: str = "scaled") -> DataFrame:
    """Min-max scaling of vectors with the range of the training rows; constant dimensions give 0."""
    ranged = df.withColumn("_r", fit_vector_range(train, vector).scalar())
    spans = F.zip_with("_r.lo", "_r.hi", lambda lo, hi: F.struct(lo.alias("lo"), (hi - lo).alias("d")))
    scaled = F.zip_with(
        F.col(vector),
        spans,
        lambda x, r: F.when(r["d"] == 0, F.lit(0.0)).otherwise(
            (x.cast("double") - r["lo"]) / r["d"]
        ),
    )
    return ranged.withColumn(out, scaled).drop("_r")


def extract_xy(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(F.col(features).alias("features"), F.col(label).alias("label"))


def ladder_features(
    counts: DataFrame, ladder: DataFrame, sets: DataFrame, key: str
) -> DataFrame:
    """Scaled terms of every set under every training size, in one job.

    ``ladder``: (n_samples, key) training rows per size. ``sets``: (n_samples, set, key) rows
    to transform. Vocabulary and ranges are fitted per size on its training rows only.
    """
    size = ladder.groupBy("n_samples").agg(F.count(F.lit(1)).alias("n_train"))
    fitted = (
        counts.join(ladder, key)
        .groupBy("n_samples", "term")
        .agg(
            F.count(F.lit(1)).alias("df"), F.min("n").alias("n_min"), F.max("n").alias("hi")
        )
        .join(size, "n_samples")
        .withColumn("lo", F.when(F.col("df") < F.col("n_train"), F.lit(0)).otherwise(F.col("n_min")))
        .select("n_samples", "term", "lo", "hi")
    )
    span = F.col("hi") - F.col("lo")
    x = F.when(span == 0, F.lit(0.0)).otherwise((F.col("n") - F.col("lo")) / span)
    return (
        counts.join(sets, key)
        .join(fitted, ["n_samples", "term"])
        .select("n_samples", "set", key, "term", x.alias("x"))
    )
