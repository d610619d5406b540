"""Registry of queries, and the test tables in the shape of the library's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_all_cores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its equivalent."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, ready for work on their text."""
    return use_all_cores(table(spark, sf, "documents"), "doc_id")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- reports: orders, the priority as severity (pending medium ones have none) ---

SEVERITY_OF = {
    "1-URGENT": "blocker",
    "2-HIGH": "major",
    "4-NOT SPECIFIED": "enhancement",
    "5-LOW": "minor",
}
REPORTS = """reports AS (
  SELECT o_orderkey AS bug_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'blocker' WHEN '2-HIGH' THEN 'major'
      WHEN '4-NOT SPECIFIED' THEN 'enhancement' WHEN '5-LOW' THEN 'minor'
      WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'normal' END END AS bug_severity,
    o_orderpriority AS short_desc, o_orderstatus AS bug_status, o_custkey AS reporter,
    o_orderdate AS creation_ts, o_totalprice AS price FROM orders)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    severity = F.when(
        (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") != "P"), "normal"
    )
    for priority, name in SEVERITY_OF.items():
        severity = severity.when(F.col("o_orderpriority") == priority, name)
    return o.select(
        F.col("o_orderkey").alias("bug_id"),
        severity.alias("bug_severity"),
        F.col("o_orderpriority").alias("short_desc"),
        F.col("o_orderstatus").alias("bug_status"),
        F.col("o_custkey").alias("reporter"),
        F.col("o_orderdate").alias("creation_ts"),
        F.col("o_totalprice").alias("price"),
    )


# --- docs: labelled texts ---

DOCS = """docs AS (
  SELECT d.doc_id AS bug_id, d.text AS description, d.lang, d.source,
    l.quality AS binary_severity, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        texts(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("bug_id"),
            F.col("text").alias("description"),
            "lang",
            "source",
            F.col("quality").alias("binary_severity"),
            "toxic",
        )
    )


# --- raw: every text with a URL, a fence and a code span around it ---

RAW = """raw AS (
  SELECT doc_id AS bug_id, lang, source,
    'see http://tracker/' || source || '/' || doc_id || ' ' || text || ' ```' || lang || chr(10)
      || 'x = 1``` and `' || source || '` end' AS description
  FROM documents)"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(
        F.col("doc_id").alias("bug_id"),
        "lang",
        "source",
        F.concat(
            F.lit("see http://tracker/"),
            "source",
            F.lit("/"),
            F.col("doc_id").cast("string"),
            F.lit(" "),
            "text",
            F.lit(" ```"),
            "lang",
            F.lit("\nx = 1``` and `"),
            "source",
            F.lit("` end"),
        ).alias("description"),
    )


# --- split of the labelled texts, 70 / 20 / 10 per class ---


def split_sql(name: str, src: str, key: str, label: str, seed: str = "0") -> str:
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}|' || {key})) AS rk,
    count(*) OVER (PARTITION BY {label}) AS nc FROM {src}),
{name} AS (
  SELECT * EXCLUDE (rk, nc), CASE WHEN rk <= (7 * nc) // 10 THEN 'tr'
    WHEN rk <= (7 * nc) // 10 + (2 * (nc - (7 * nc) // 10)) // 3 THEN 'val' ELSE 'test' END AS split
  FROM {name}_r)"""


SPLIT = split_sql("sdocs", "docs", "bug_id", "binary_severity")

# --- bag of words of the labelled texts ---

BOW = """terms AS (
  SELECT bug_id, unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs),
bow AS (SELECT bug_id, term, count(*) AS n FROM terms GROUP BY bug_id, term)"""

# --- judged: predictions for the labelled texts; NaN and null are failed answers ---

JUDGED = """judged AS (
  SELECT bug_id, binary_severity, lang AS dataset, source,
    CASE bug_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0
      WHEN 4 THEN 'NaN'::DOUBLE ELSE NULL END::DOUBLE AS severity_pred,
    CASE bug_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE -2 END AS code
  FROM docs)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("bug_id") % 6
    pred = (
        F.when(m.isin(0, 2), F.lit(1.0))
        .when(m == 1, F.lit(0.0))
        .when(m == 3, F.lit(-1.0))
        .when(m == 4, F.lit(float("nan")))
    )
    return docs(spark, sf).select(
        "bug_id", "binary_severity", F.col("lang").alias("dataset"), "source", pred.alias("severity_pred")
    )


# --- answers: free-text answers for every text ---

ANSWERS = """answers AS (
  SELECT doc_id AS bug_id, CASE doc_id % 7 WHEN 0 THEN 'SEVERE' WHEN 1 THEN 'Not  severe' WHEN 2 THEN '0'
    WHEN 3 THEN '1' WHEN 4 THEN '0 or 1' WHEN 5 THEN text || ' is severe' ELSE '' END AS answer,
    text FROM documents)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    fixed = ["SEVERE", "Not  severe", "0", "1", "0 or 1"]
    m = F.col("doc_id") % 7
    answer = F.when(m == 5, F.concat("text", F.lit(" is severe")))
    for i, value in enumerate(fixed):
        answer = answer.when(m == i, value)
    return d.select(
        F.col("doc_id").alias("bug_id"), answer.otherwise("").alias("answer"), "text"
    )


# --- scored: binary scores of five models ---

SCORED = """scored AS (
  SELECT event_id AS id, event_type AS model, user_id, ts,
    (value / 500.0)::DOUBLE AS score,
    CASE WHEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) >= 50 THEN 1 ELSE 0 END AS y
  FROM events)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("model"),
        "user_id",
        "ts",
        (F.col("value") / 500.0).alias("score"),
        F.when(F.get_json_object("props", "$.k").cast("int") >= 50, 1).otherwise(0).alias("y"),
    )


# --- steps: the training log of many runs ---

STEPS = """steps AS (
  SELECT id AS bug_id, user_id AS run,
    CASE WHEN model IN ('view', 'click', 'purchase') THEN 'train' ELSE 'val' END AS dataset_type,
    CAST(extract(day FROM ts) AS INT) AS epoch, id // 4 AS batch_id, score AS probability,
    CAST(round(score * 500) AS BIGINT) AS loss, y AS binary_severity, ts FROM scored)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.select(
        F.col("id").alias("bug_id"),
        F.col("user_id").alias("run"),
        F.when(F.col("model").isin("view", "click", "purchase"), "train").otherwise("val").alias("dataset_type"),
        F.dayofmonth("ts").alias("epoch"),
        F.expr("id div 4").alias("batch_id"),
        F.col("score").alias("probability"),
        F.round(F.col("score") * 500).cast("long").alias("loss"),
        F.col("y").alias("binary_severity"),
        "ts",
    )


# --- results: one row per run and data set, with its parameters and a metric ---

RESULTS = """results AS (
  SELECT run, dataset_type, CASE WHEN run % 2 = 0 THEN 'eclipse' ELSE 'mozilla' END AS dataset_choice,
    CASE WHEN run % 3 = 0 THEN 'alpaca' ELSE 'official' END AS prompt_id,
    CASE WHEN run % 4 < 2 THEN '0.0001' ELSE '0.00001' END AS learning_rate,
    CASE run % 5 WHEN 0 THEN '5' WHEN 1 THEN '10' ELSE '64' END AS lora_r, 'nf4' AS quant,
    max(probability) AS roc_auc, max(epoch) AS epoch, count(*) AS n_rows
  FROM steps GROUP BY run, dataset_type)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    agg = (
        steps(spark, sf)
        .groupBy("run", "dataset_type")
        .agg(
            F.max("probability").alias("roc_auc"),
            F.max("epoch").alias("epoch"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
    run = F.col("run")
    return agg.withColumns(
        {
            "dataset_choice": F.when(run % 2 == 0, "eclipse").otherwise("mozilla"),
            "prompt_id": F.when(run % 3 == 0, "alpaca").otherwise("official"),
            "learning_rate": F.when(run % 4 < 2, "0.0001").otherwise("0.00001"),
            "lora_r": F.when(run % 5 == 0, "5").when(run % 5 == 1, "10").otherwise("64"),
            "quant": F.lit("nf4"),
        }
    )


# --- vectors: embeddings with a binary label and a split ---

VECTORS = "vectors AS (SELECT vec_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings)"
SVECTORS = split_sql("svec", "vectors", "vec_id", "y")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y")
    )
