"""Incremental forms of batch operators as Structured Streaming queries.

Each job runs over what its source holds now (``availableNow``) and can be started again on
the same checkpoint folder to continue.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


BATCH_BYTES = 1 << 30  # of files admitted to one micro-batch


def stream_folder(
    spark: SparkSession, path: str, like: DataFrame, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """A Parquet folder as a stream, with the schema of ``like``; batches are bounded by the bytes of their files."""
    return spark.readStream.schema(like.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def nb_counts_stream(docs: DataFrame, text: str, label: str) -> DataFrame:
    """Running (class, term) sums: the sufficient statistics of naive Bayes."""
    rows = docs.select(F.col(label).alias("label"), F.explode(tx.terms(F.col(text))).alias("term"))
    return rows.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))


def run_nb_counts(docs: DataFrame, text: str, label: str, sink: str, checkpoint: str) -> None:
    """Write the changed sums of every micro-batch under its number.

    The sink keeps changes, not the whole table; ``latest_counts`` reads the current state.
    A batch replayed after a failure overwrites its own folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = (
        nb_counts_stream(docs, text, label)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """Newest sum per (class, term); sums only grow, so the newest is the largest."""
    return spark.read.parquet(sink).groupBy("label", "term").agg(F.max("n").alias("n"))


def run_resume(
    rows: DataFrame,
    key: str,
    done: DataFrame | None,
    sink: str,
    checkpoint: str,
    override: bool = False,
) -> None:
    """Append rows whose key is not done yet, once per key; ``override`` does those of ``done`` again.

    A batch leaves out what the sink has from earlier batches and runs, however long ago and in whatever order rows
    come: no row is late. Each batch has a folder of its own, named after the checkpoint and its number, so a replay
    overwrites what it wrote and looks only at what came before. Of the sink only keys are read.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    kept = T.StructType([*rows.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if done is not None and not override:
            fresh = fresh.join(done.select(key), key, "left_anti")
        if _exists(spark, sink):
            before = spark.read.schema(kept).parquet(sink).filter((F.col("run") != run) | (F.col("batch") < number))
            fresh = fresh.join(before.select(key), key, "left_anti")
        fresh.select(*rows.columns).write.mode("overwrite").parquet(f"{sink}/run={run}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def epoch_metrics_stream(
    steps: DataFrame, time: str, epoch_length: str, delay: str, run: str
) -> DataFrame:
    """Loss, rows and right answers per (epoch, run); a group leaves when the watermark closes it."""
    right = (F.col("prediction") == F.col("binary_severity")).cast("long")
    return (
        steps.withWatermark(time, delay)
        .groupBy(F.window(time, epoch_length).alias("epoch"), run)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("loss").alias("loss_sum"),
            F.sum(right).alias("n_right"),
        )
    )


def run_epoch_metrics(
    steps: DataFrame, time: str, epoch_length: str, delay: str, run: str, sink: str, checkpoint: str
) -> None:
    query = (
        epoch_metrics_stream(steps, time, epoch_length, delay, run)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
