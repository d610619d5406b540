"""Writers. Every path must lie on storage that all executors share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import assign_split
from ..operators.metrics import class_scores, confusion_matrix


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.json(path)


def write_feature_set(df: DataFrame, path: str, feature_set: str, n_samples: int) -> None:
    """Append one feature set; sets and sizes are folders, so a reader sees only its own."""
    tagged = df.withColumns(
        {"feature_set": F.lit(feature_set), "n_samples": F.lit(int(n_samples))}
    )
    tagged.write.mode("append").partitionBy("feature_set", "n_samples").parquet(path)


def read_feature_set(
    spark: SparkSession, path: str, feature_set: str, n_samples: int
) -> DataFrame:
    """One stored feature set."""
    stored = spark.read.parquet(path)
    return stored.filter(
        (F.col("feature_set") == feature_set) & (F.col("n_samples") == n_samples)
    )


def check_width(df: DataFrame, vector: str) -> DataFrame:
    """Fail unless the vectors of all rows, whatever their split, have one width."""
    row = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"feature width differs: {row['lo']} and {row['hi']}")
    return df


def write_split_sets(df: DataFrame, splits: DataFrame, path: str, key: str) -> bool:
    """Rows by split in their own folders; an existing complete target is left as it is."""
    if path_exists(df.sparkSession, path):
        return False
    assign_split(df, splits, key).write.mode("overwrite").partitionBy("split").parquet(path)
    return True


def metrics_record(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: nested confusion matrix and F1 list in label order, with a time stamp.

    Both arrays are as long as the label set of a classifier.
    """
    cells = confusion_matrix(df, true, pred)
    rows = cells.groupBy("true_label").agg(
        F.array_sort(F.collect_list(F.struct("pred_label", "n"))).alias("cells")
    )
    matrix = rows.agg(F.array_sort(F.collect_list(F.struct("true_label", "cells"))).alias("m"))
    nested = F.transform("m", lambda r: F.transform(r["cells"], lambda c: c["n"]))
    scores = class_scores(df, true, pred).agg(
        F.array_sort(F.collect_list(F.struct("label", "f1"))).alias("s")
    )
    return matrix.select(nested.alias("confusion_matrix")).withColumn("s", scores.scalar()).select(
        "confusion_matrix",
        F.transform("s", lambda x: x["f1"]).alias("f1"),
        F.current_timestamp().alias("written_at"),
    )


def append_manifest(spark: SparkSession, path: str, run: str, arguments: Mapping[str, object]) -> None:
    """One row with the arguments of a run."""
    params = {k: str(v) for k, v in arguments.items()}
    row = spark.createDataFrame([(run, params)], "run string, params map<string,string>")
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)
