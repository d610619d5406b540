"""Streaming queries: each runs over the whole source and returns its sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_folder
from ..streaming import jobs
from .base import DOCS, SCORED, STEPS, query, sql, steps, table


@query("stream_nb_counts", sql(DOCS, body="""
SELECT binary_severity AS label, term, count(*) AS n FROM (SELECT binary_severity, unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs) GROUP BY ALL"""))
def stream_nb_counts(spark, sf):
    """The texts' own folder as a stream, each batch joined with the labels."""
    d, sink = table(spark, sf, "documents"), fresh_folder(spark, "nb")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("binary_severity"))
    folder = f"{sf}/documents.parque[t]"  # a pattern, as the table may be a folder or one file
    stream = jobs.stream_folder(spark, folder, d).join(labels, "doc_id")
    jobs.run_nb_counts(stream, "text", "binary_severity", sink, fresh_folder(spark, "check"))
    return jobs.latest_counts(spark, sink)


@query("stream_resume_dedup", """
SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)""")
def stream_resume_dedup(spark, sf):
    """Events arrive twice; those whose id is labelled are done already."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    source, sink = fresh_folder(spark, "events"), fresh_folder(spark, "resume")
    e.union(e).write.parquet(source)
    done = table(spark, sf, "labels").withColumnRenamed("doc_id", "event_id")
    stream = jobs.stream_folder(spark, source, e)
    jobs.run_resume(stream, "event_id", done, sink, fresh_folder(spark, "check"))
    return spark.read.schema(e.schema).parquet(sink).select("event_id")


@query("stream_epoch_metrics", sql(SCORED, STEPS, body="""
, day AS (SELECT CAST(ts AS DATE) AS d, dataset_type, count(*) AS n_rows, CAST(sum(loss) AS BIGINT) AS loss_sum, count_if((probability >= 0.05)::INT = binary_severity)::BIGINT AS n_right FROM steps GROUP BY ALL)
SELECT CAST(d AS VARCHAR) AS epoch, dataset_type, n_rows, loss_sum, n_right FROM day
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM steps)"""))
def stream_epoch_metrics(spark, sf):
    """Days as epochs. The last day stays open: no later record closes it."""
    s = steps(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"),
        "dataset_type",
        "loss",
        (F.col("probability") >= 0.05).cast("int").alias("prediction"),
        "binary_severity",
    )
    source, sink = fresh_folder(spark, "steps"), fresh_folder(spark, "epochs")
    s.write.parquet(source)
    stream = jobs.stream_folder(spark, source, s)
    jobs.run_epoch_metrics(stream, "ts", "1 day", "1 hour", "dataset_type", sink, fresh_folder(spark, "check"))
    found = spark.read.schema(
        "epoch struct<start:timestamp,end:timestamp>, dataset_type string, n_rows long, loss_sum long, n_right long"
    ).parquet(sink)
    return found.withColumn("epoch", F.date_format("epoch.start", "yyyy-MM-dd"))
