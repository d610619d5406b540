"""Splits, folds, samples and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as sp
from .base import DOCS, REPORTS, docs, query, r6, reports, split_sql, sql, table

LABELLED = "lab AS (SELECT bug_id, CASE WHEN bug_severity IN ('blocker', 'critical', 'major') THEN 1 ELSE 0 END AS y FROM reports)"


def _labelled(spark, sf):
    severe = F.col("bug_severity").isin("blocker", "critical", "major")
    return reports(spark, sf).select("bug_id", F.when(severe, 1).otherwise(0).alias("y"))


@query("stratified_split", sql(REPORTS, LABELLED, split_sql("s", "lab", "bug_id", "y"), body="SELECT bug_id, y, split FROM s"))
def stratified_split(spark, sf):
    return sp.stratified_split(_labelled(spark, sf), "bug_id", "y")


@query("shuffle_split", sql(REPORTS, LABELLED, body="""
SELECT bug_id, y, CASE WHEN rk <= (20 * nc) // 100 THEN 'test' ELSE 'tr' END AS split FROM (SELECT *, row_number() OVER
 (PARTITION BY y ORDER BY md5('1|' || bug_id)) AS rk, count(*) OVER (PARTITION BY y) AS nc FROM lab)"""))
def shuffle_split(spark, sf):
    return sp.shuffle_split(_labelled(spark, sf), "bug_id", "y", 20, seed=1)


@query("stratified_kfold", sql(REPORTS, LABELLED, body="""
SELECT seed, bug_id, y, CAST((row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || '|' || bug_id)) - 1) % 5 AS INT) AS fold
FROM lab, (SELECT unnest([0, 1, 2]) AS seed)"""))
def stratified_kfold(spark, sf):
    return sp.stratified_kfold(_labelled(spark, sf), "bug_id", "y", 5, [0, 1, 2]).select(
        "seed", "bug_id", "y", "fold"
    )


@query("balanced_sample", sql(DOCS, body="""
SELECT epoch, bug_id, binary_severity, draw FROM (SELECT epoch, bug_id, binary_severity, row_number() OVER
  (PARTITION BY epoch, binary_severity ORDER BY md5(epoch || '|' || bug_id)) AS draw FROM docs, (SELECT unnest([0, 1, 2]) AS epoch))
WHERE draw <= (SELECT min(n) FROM (SELECT count(*) AS n FROM docs GROUP BY binary_severity))"""))
def balanced_sample(spark, sf):
    rows = docs(spark, sf).select("bug_id", "binary_severity")
    return sp.balanced_sample(rows, "bug_id", "binary_severity", [0, 1, 2]).select(
        "epoch", "bug_id", "binary_severity", "draw"
    )


LADDER = [200, 500, 1000, 2000, 4000, 8000, -1]


@query("sample_ladder", sql(REPORTS, body="""
SELECT n_samples, bug_id FROM (SELECT bug_id, row_number() OVER (ORDER BY md5('0|' || bug_id)) AS rk FROM reports),
 (SELECT unnest([200, 500, 1000, 2000, 4000, 8000, -1]) AS n_samples) WHERE n_samples = -1 OR rk <= n_samples"""))
def sample_ladder(spark, sf):
    ids = reports(spark, sf).select("bug_id")
    return sp.sample_ladder(ids, "bug_id", LADDER).select("n_samples", "bug_id")


@query("chunk_ranges", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents),
c AS (SELECT *, CAST(least((rn - 1) // (n // 7), 6) AS INT) AS chunk FROM r)
SELECT chunk, min(rn) - 1 AS start, max(rn) AS "end", min(doc_id) AS first_key, max(doc_id) AS last_key FROM c GROUP BY chunk""")
def chunk_ranges(spark, sf):
    return sp.chunk_ranges(table(spark, sf, "documents"), "doc_id", 7)


@query("fixed_groups", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT (rn - 1) // 64 AS group_id, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members, count(*) AS n_members FROM r GROUP BY ALL""")
def fixed_groups(spark, sf):
    found = sp.fixed_groups(table(spark, sf, "orders"), "o_orderkey", 64)
    return found.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query("class_weight", sql(DOCS, body="""
SELECT count_if(binary_severity = 0)::BIGINT AS n_negative, count_if(binary_severity = 1)::BIGINT AS n_positive,
  round(count_if(binary_severity = 0) / count_if(binary_severity = 1)::DOUBLE, 6) AS pos_weight FROM docs"""))
def class_weight(spark, sf):
    found = sp.class_weight(docs(spark, sf), "binary_severity")
    return found.withColumn("pos_weight", r6("pos_weight"))
