"""Readers for reports, splits, predictions and run folders. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.labels import DROPPED, binary_label

RAW_REPORT = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("bug_id", T.LongType()),
        T.StructField("bug_severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("short_desc", T.StringType()),
        T.StructField("creation_ts", T.StringType()),
        T.StructField("bug_status", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("product", T.StringType()),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("bug_id", T.LongType()),
        T.StructField("bug_severity", T.StringType()),
        T.StructField("binary_severity", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("stemmed_description", T.StringType()),
    ]
)
SPLIT = T.StructType(
    [T.StructField(s, T.ArrayType(T.LongType())) for s in ("tr", "val", "test")]
)
PREDICTION = T.StructType(
    [
        T.StructField("bug_id", T.LongType()),
        T.StructField("binary_severity", T.IntegerType()),
        T.StructField("answer", T.StringType()),
        T.StructField("severity_pred", T.DoubleType()),
    ]
)
PARAMETERS = "map<string,string>"


def list_or_text(c: Column) -> Column:
    """A text that may be written as a JSON array of strings -> one string."""
    parts = F.from_json(c, "array<string>")
    return F.when(c.startswith("[") & parts.isNotNull(), tx.join_text(parts)).otherwise(c)


CORRUPT = "_corrupt_record"


def _checked_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path, split, value, r): every line with the record read from it; ``r`` tells in CORRUPT if it is none."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", kept, {"columnNameOfCorruptRecord": CORRUPT})
    split = F.col("_metadata.file_block_start").alias("split")
    return lines.select(file_path().alias("path"), split, "value", record.alias("r"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_REPORT) -> DataFrame:
    """One record per line; broken lines are left to ``rejected_lines``."""
    rows = _checked_lines(spark, path, schema).filter(F.col("r")[CORRUPT].isNull())
    return rows.select(*[F.col("r")[c].alias(c) for c in schema.fieldNames()])


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_REPORT) -> DataFrame:
    """(path, split, value): lines that are no record of the schema, with their file and the start of the split they lie in."""
    rows = _checked_lines(spark, path, schema)
    return rows.filter(F.col("r")[CORRUPT].isNotNull()).select("path", "split", "value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = REPORT) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = REPORT) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_split(spark: SparkSession, path: str, key: str = "bug_id") -> DataFrame:
    """Split objects ``{"tr": [...], "val": [...], "test": [...]}`` -> (key, split)."""
    obj = spark.read.schema(SPLIT).option("multiLine", False).json(path)
    sides = F.array(
        *[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in SPLIT.fieldNames()]
    )
    return obj.select(F.inline(sides)).select(F.explode("ids").alias(key), "split")


def parse_report_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw lines -> (_id, bug_id, severity, description); broken, dropped and empty rows vanish."""
    rows = lines.select(F.inline(F.array(F.from_json(F.trim(F.col(column)), RAW_REPORT))))
    listed = F.coalesce(F.col("bug_severity").isin(*DROPPED), F.lit(False))
    text = tx.strip_space(list_or_text(F.col("description")))
    return (
        rows.filter(F.col("bug_id").isNotNull() & ~listed)
        .select(
            "_id",
            "bug_id",
            binary_label(F.col("bug_severity")).alias("severity"),
            tx.once(text, lambda t: F.length(t) > 0).alias("description"),
        )
        .withColumn("description", tx.replace_urls(F.col("description")))
    )


def file_path() -> Column:
    return F.col("_metadata.file_path")


def _prediction_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, value, records): the records of each line that holds some, null where it is broken."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    lines = reader.text(path).select(file_path().alias("path"), F.trim("value").alias("value")).filter("value <> ''")
    kept = T.StructType([*PREDICTION.fields, T.StructField(CORRUPT, T.StringType())])
    one = F.from_json("value", kept, {"columnNameOfCorruptRecord": CORRUPT})
    many = F.from_json("value", T.ArrayType(PREDICTION))
    single = F.when(
        F.col("value").startswith("{") & one[CORRUPT].isNull(),
        F.array(F.struct(*[one[c].alias(c) for c in PREDICTION.fieldNames()])),
    )
    return lines.select("path", "value", F.when(F.col("value").startswith("["), many).otherwise(single).alias("records"))


def _whole_arrays(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, records) of files that are one array, however it is laid out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(
        file_path().alias("path"), "value", F.from_json("value", T.ArrayType(PREDICTION)).alias("records")
    )
    return files.filter(F.ltrim("value", F.lit(" \t\r\n")).startswith("[") & F.col("records").isNotNull()).drop("value")


def read_predictions(
    spark: SparkSession, path: str, keep_path: bool = False, glob: str = "*.json"
) -> DataFrame:
    """All prediction files below a folder: JSON lines, one-line arrays, or one array of any layout.

    A file with lines that are no records is tried as one array; if it is none, its good lines count
    and the others are left to ``rejected_predictions``. Blank lines are skipped.
    """
    lines = _prediction_lines(spark, path, glob)
    rest = ["path"] if keep_path else []
    broken = lines.filter("records is null").select("path").distinct()
    if broken.isEmpty():
        return lines.select(*rest, F.inline("records"))
    whole = _whole_arrays(spark, path, glob).join(broken, "path", "left_semi")
    good = lines.filter("records is not null").join(whole.select("path"), "path", "left_anti")
    return good.select("path", "records").union(whole).select(*rest, F.inline("records"))


def rejected_predictions(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, value): lines of prediction files that hold no record and belong to no array."""
    broken = _prediction_lines(spark, path, glob).filter("records is null").select("path", "value")
    return broken.join(_whole_arrays(spark, path, glob).select("path"), "path", "left_anti")


def run_folder(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_runs(spark: SparkSession, predictions: str, parameters: str) -> DataFrame:
    """Prediction rows of many run folders with the parameters of their run."""
    rows = read_predictions(spark, predictions, keep_path=True).withColumn(
        "run", run_folder(F.col("path"))
    )
    return rows.drop("path").join(read_parameters(spark, parameters), "run", "inner")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(run, params) of the parameter files in run folders."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        run_folder(file_path()).alias("run"), F.from_json("value", PARAMETERS).alias("params")
    )


def read_run_metrics(spark: SparkSession, metrics: str, parameters: str) -> DataFrame:
    """Per-epoch metrics joined to run parameters; a run without both sides is dropped."""
    lines = spark.read.option("recursiveFileLookup", True).text(metrics)
    rows = lines.select(
        run_folder(file_path()).alias("run"),
        F.inline(F.from_json("value", "array<struct<epoch:int,loss:double,f1:double>>")),
    )
    return rows.join(read_parameters(spark, parameters), "run", "inner")


def name_parts(path: Column, datasets: Sequence[str] = ("eclipse", "mozilla")) -> dict[str, Column]:
    """What a file name says: dataset (one of ``datasets``, the last it names), algorithm group, sample size, epoch, split."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    number = lambda pattern: F.when(
        base.rlike(pattern), F.regexp_extract(base, pattern, 1).cast("int")
    )
    algorithm = (
        F.when(base.contains("nb_non_bino"), "nb_counts")
        .when(base.contains("nb_bino"), "nb_binary")
        .when(base.contains("svm_knn"), "svm_knn")
    )
    split = (
        F.when(base.rlike("_val(_|\\.)"), "val")
        .when(base.rlike("_test(_|\\.)"), "test")
        .when(base.rlike("_(tr|train)(_|\\.)"), "tr")
    )
    return {
        "dataset": F.regexp_extract(base, ".*(" + "|".join(map(re.escape, datasets)) + ")", 1),
        "algorithm": algorithm,
        "n_samples": number(r"(\d+)_samples"),
        "epoch": number(r"epoch_(\d+)"),
        "split": split,
    }
