"""Joins, dedup, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import missing_to_failed
from ..operators import dedup as dd
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators.knn import knn_join as nearest_rows
from ..operators.knn import knn_predict as vote
from ..operators.ranks import ordered_rank
from ..operators.splits import grid_sample as sample_grid
from ..operators.splits import parameter_grid, stratified_split
from ..session import materialise
from .base import (
    DOCS,
    JUDGED,
    REPORTS,
    RESULTS,
    SCORED,
    SPLIT,
    STEPS,
    SVECTORS,
    VECTORS,
    docs,
    judged,
    query,
    r6,
    reports,
    results,
    scored,
    split_sql,
    sql,
    table,
    vectors,
)

# --- joins ---


@query("semi_split", sql(DOCS, SPLIT, body="""
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT bug_id FROM sdocs WHERE split = 'tr')"""))
def semi_split(spark, sf):
    train = stratified_split(docs(spark, sf), "bug_id", "binary_severity").filter("split = 'tr'")
    found = table(spark, sf, "documents").withColumnRenamed("doc_id", "bug_id")
    return jn.keep_ids(found, train, "bug_id").select(
        F.col("bug_id").alias("doc_id"), "lang", "source"
    )


@query("assign_split", """
WITH s AS (SELECT l_partkey AS p_partkey, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS o
  FROM lineitem GROUP BY l_partkey)
SELECT p.p_partkey, p_name, CASE o WHEN 1 THEN 'tr' WHEN 2 THEN 'val' ELSE 'test' END AS split
FROM part p JOIN s ON p.p_partkey = s.p_partkey""")
def assign_split(spark, sf):
    """Parts fall in several splits through their order lines; the first split wins."""
    flag = F.col("l_returnflag")
    lists = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.when(flag == "A", "tr").when(flag == "N", "val").otherwise("test").alias("split"),
    )
    return jn.assign_split(table(spark, sf, "part"), lists, "p_partkey").select(
        "p_partkey", "p_name", "split"
    )


@query("left_backfill", sql(DOCS, JUDGED, body="""
SELECT d.doc_id AS bug_id, coalesce(CASE WHEN j.binary_severity = 1 THEN 1 END, l.quality) AS binary_severity
FROM documents d LEFT JOIN judged j ON d.doc_id = j.bug_id LEFT JOIN labels l ON d.doc_id = l.doc_id"""))
def left_backfill(spark, sf):
    some = judged(spark, sf).select(
        "bug_id", F.when(F.col("binary_severity") == 1, 1).alias("binary_severity")
    )
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("bug_id"))
    reference = table(spark, sf, "labels").select(
        F.col("doc_id").alias("bug_id"), F.col("quality").alias("binary_severity")
    )
    return jn.backfill_column(ids.join(some, "bug_id", "left"), reference, "bug_id", "binary_severity")


@query("coverage_check", """
SELECT count(*) AS n_missing, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS covered
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def coverage_check(spark, sf):
    return jn.coverage_check(
        table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"
    )


@query("inner_dedup_join", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT c_custkey, c_name, event_id, event_type FROM customer JOIN e ON c_custkey = user_id WHERE rn = 1""")
def inner_dedup_join(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    right = events.select("c_custkey", "event_id", "event_type")
    left = table(spark, sf, "customer").select("c_custkey", "c_name")
    return jn.inner_dedup_join(left, right, "c_custkey", ["event_id"])


@query("embedding_label_join", sql(VECTORS, SVECTORS, body="""
SELECT vec_id, split, quality, toxic, dim::INT AS dim, round(v::DOUBLE, 6) AS value FROM (SELECT s.vec_id, s.split, l.quality, l.toxic,
  unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM svec s JOIN labels l ON s.vec_id = l.doc_id)"""))
def embedding_label_join(spark, sf):
    v = vectors(spark, sf)
    split = stratified_split(v.select("vec_id", "y"), "vec_id", "y").select("vec_id", "split")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    joined = v.join(labels, "vec_id").join(split, "vec_id")
    cells = joined.select("vec_id", "split", "quality", "toxic", F.posexplode("embedding").alias("dim", "v"))
    return cells.select("vec_id", "split", "quality", "toxic", "dim", r6(F.col("v").cast("double")).alias("value"))


@query("missing_ids", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_ids(spark, sf):
    expected = table(spark, sf, "documents").select("doc_id", "lang")
    return jn.missing_ids(expected, table(spark, sf, "labels"), ["doc_id"])


ALL_DOCS = "alldocs AS (SELECT doc_id AS bug_id, lang FROM documents)"
ALL_SPLIT = split_sql("asplit", "alldocs", "bug_id", "lang")
PREDICTED = """predicted AS (
  SELECT a.lang AS dataset, a.split, CASE WHEN l.toxic = 1 THEN 'official' ELSE 'alpaca' END AS prompt_id,
    a.bug_id, l.quality AS severity_pred FROM asplit a JOIN labels l ON a.bug_id = l.doc_id)"""


def _expected_and_predicted(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("bug_id"), "lang")
    split = stratified_split(ids, "bug_id", "lang").select(
        F.col("lang").alias("dataset"), "split", "bug_id"
    )
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "bug_id")
    expected = split.join(labels.select("bug_id", F.col("quality").alias("binary_severity")), "bug_id", "left")
    predicted = split.join(labels, "bug_id").select(
        "dataset",
        "split",
        F.when(F.col("toxic") == 1, "official").otherwise("alpaca").alias("prompt_id"),
        "bug_id",
        F.col("quality").alias("binary_severity"),
        F.col("quality").alias("severity_pred"),
    )
    return expected, predicted


@query("backfill_missing", sql(ALL_DOCS, ALL_SPLIT, PREDICTED, body="""
SELECT a.lang AS dataset, a.split, g.prompt_id, a.bug_id, l.quality AS binary_severity,
  coalesce(p.severity_pred, -2) AS severity_pred
FROM asplit a JOIN (SELECT DISTINCT dataset, split, prompt_id FROM predicted) g ON a.lang = g.dataset AND a.split = g.split
LEFT JOIN labels l ON a.bug_id = l.doc_id
LEFT JOIN predicted p ON p.bug_id = a.bug_id AND p.prompt_id = g.prompt_id"""))
def backfill_missing(spark, sf):
    expected, predicted = _expected_and_predicted(spark, sf)
    full = jn.backfill_missing(
        predicted,
        expected,
        ["dataset", "split"],
        "bug_id",
        "binary_severity",
        "prompt_id",
        ["severity_pred"],
    )
    return full.select("dataset", "split", "prompt_id", "bug_id", "binary_severity", "severity_pred")


@query("label_grid", sql(DOCS, JUDGED, body="""
SELECT t.l AS true_label, p.l AS pred_label, count(j.bug_id) AS n
FROM (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged) t
CROSS JOIN (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged) p
LEFT JOIN judged j ON j.binary_severity = t.l AND j.code = p.l GROUP BY t.l, p.l"""))
def label_grid(spark, sf):
    j = judged(spark, sf).withColumn("code", missing_to_failed(F.col("severity_pred")))
    cells = mt.cell_counts(j, "binary_severity", "code")
    grid = jn.label_grid(cells, "true_label", "pred_label")
    return grid.join(cells, ["true_label", "pred_label"], "left").fillna(0, subset=["n"])


# The choices of the fine-tuning grid.
GRID = {
    "learning_rate": ["1e-4", "1e-5"],
    "lora_r": [10, 64, 5],
    "weighted": [1, 0],
    "lora_alpha": [4, 10],
    "dropout": ["0.1", "0", "0.2"],
    "tr_weighted_sampling": [0, 1],
}
STUDIES = "studies AS (SELECT DISTINCT lang AS dataset, source FROM documents)"
GRID_SQL = """grid AS (SELECT dataset, source, learning_rate, lora_r, weighted, lora_alpha, dropout, tr_weighted_sampling
  FROM studies, (SELECT unnest(['1e-4', '1e-5']) AS learning_rate), (SELECT unnest([10, 64, 5]) AS lora_r),
  (SELECT unnest([1, 0]) AS weighted), (SELECT unnest([4, 10]) AS lora_alpha),
  (SELECT unnest(['0.1', '0', '0.2']) AS dropout), (SELECT unnest([0, 1]) AS tr_weighted_sampling))"""


def _grid(spark, sf):
    studies = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), "source").distinct()
    return parameter_grid(studies, GRID)


@query("param_grid", sql(STUDIES, GRID_SQL, body="SELECT * FROM grid"))
def param_grid(spark, sf):
    return _grid(spark, sf)


@query("grid_sample", sql(STUDIES, GRID_SQL, body="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY md5('0|' || dataset || '|' || source || '|'
  || learning_rate || '|' || lora_r || '|' || weighted || '|' || lora_alpha || '|' || dropout || '|' || tr_weighted_sampling)) AS draw
  FROM grid) WHERE draw <= 30"""))
def grid_sample(spark, sf):
    drawn = sample_grid(_grid(spark, sf), ["dataset", "source"], list(GRID), 30)
    return drawn.withColumn("draw", F.col("draw").cast("long"))


def knn_sql(p: int) -> str:
    """All pairs in SQL; distances as written out powers."""
    gap = {
        1: "list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))",
        2: "sqrt(list_sum(list_transform(range(1, 65), lambda i: power(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE, 2))))",
        3: "power(list_sum(list_transform(range(1, 65), lambda i: power(abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE), 3))), 1.0 / 3)",
    }[p]
    return f"""pairs AS (
  SELECT q.vec_id AS query_id, q.split, q.y AS qy, t.vec_id AS neighbour_id, t.y AS ty, {gap} AS distance
  FROM svec q, svec t WHERE q.split <> 'tr' AND t.split = 'tr'),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs) WHERE rank <= 5)"""


def _sides(spark, sf):
    s = stratified_split(vectors(spark, sf), "vec_id", "y")
    return s.filter("split <> 'tr'"), s.filter("split = 'tr'")


def _neighbours(spark, sf, p):
    asked, train = _sides(spark, sf)
    return nearest_rows(asked, train, "vec_id", "embedding", k=5, p=p)


def _shown(found):
    return found.select(
        "query_id", "neighbour_id", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank")
    )


KNN_BODY = "SELECT query_id, neighbour_id, round(distance, 6) AS distance, rank FROM near"


@query("knn_join", sql(VECTORS, SVECTORS, knn_sql(2), body=KNN_BODY))
def knn_join(spark, sf):
    return _shown(_neighbours(spark, sf, 2))


@query("knn_join_p1", sql(VECTORS, SVECTORS, knn_sql(1), body=KNN_BODY))
def knn_join_p1(spark, sf):
    return _shown(_neighbours(spark, sf, 1))


@query("knn_join_p3", sql(VECTORS, SVECTORS, knn_sql(3), body=KNN_BODY))
def knn_join_p3(spark, sf):
    return _shown(_neighbours(spark, sf, 3))


@query("knn_predict", sql(VECTORS, SVECTORS, knn_sql(2), body="""
SELECT query_id, qy AS y, round(avg(ty), 6) AS uniform_prob, round(sum(ty / distance) / sum(1 / distance), 6) AS distance_prob,
  CASE WHEN avg(ty) > 0.5 THEN 1 ELSE 0 END AS pred FROM near GROUP BY query_id, qy"""))
def knn_predict(spark, sf):
    asked, train = _sides(spark, sf)
    found = materialise(nearest_rows(asked, train, "vec_id", "embedding", k=5, p=2, carried=["y"]), "near")
    even = vote(found, train, "vec_id", "y").select("query_id", F.col("prob").alias("u"), "pred")
    near = vote(found, train, "vec_id", "y", "distance").select("query_id", F.col("prob").alias("d"))
    truth = asked.select(F.col("vec_id").alias("query_id"), "y")
    return (
        truth.join(even, "query_id")
        .join(near, "query_id")
        .select("query_id", "y", r6("u").alias("uniform_prob"), r6("d").alias("distance_prob"), "pred")
    )


# --- dedup, order, top rows ---


@query("dedup_first", """
SELECT doc_id, lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return dd.first_per_key(d, ["text"], ["doc_id"])


@query("dedup_composite", """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER
  (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_composite(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return dd.first_per_key(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("has_duplicates", """
SELECT CASE WHEN max(n) > 1 THEN 1 ELSE 0 END AS has_duplicates, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def has_duplicates(spark, sf):
    return dd.has_duplicates(table(spark, sf, "documents"), ["text"])


@query("cell_representatives", sql(DOCS, JUDGED, body="""
SELECT t.l AS true_label, p.l AS pred_label, (SELECT coalesce(string_agg(bug_id, ',' ORDER BY bug_id), '') FROM
  (SELECT bug_id, binary_severity AS b, code AS c, row_number() OVER (PARTITION BY binary_severity, code ORDER BY bug_id) AS rn FROM judged) x
  WHERE rn <= 3 AND x.b = t.l AND x.c = p.l) AS samples
FROM (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged) t
CROSS JOIN (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged) p"""))
def cell_representatives(spark, sf):
    j = judged(spark, sf).withColumn("code", missing_to_failed(F.col("severity_pred")))
    found = mt.representatives(j, "binary_severity", "code", "bug_id", 3, ["dataset"])
    ids = F.array_join(F.transform("samples", lambda s: s["bug_id"].cast("string")), ",")
    return found.select("true_label", "pred_label", ids.alias("samples"))


@query("best_per_group", sql(SCORED, STEPS, RESULTS, body="""
SELECT dataset_choice, prompt_id, run, round(roc_auc, 6) AS roc_auc FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_choice, prompt_id ORDER BY roc_auc DESC, run) AS rn FROM results WHERE dataset_type = 'val') WHERE rn = 1"""))
def best_per_group(spark, sf):
    val = results(spark, sf).filter("dataset_type = 'val'")
    best = dd.best_per_group(val, ["dataset_choice", "prompt_id"], "roc_auc", "run")
    return best.select("dataset_choice", "prompt_id", "run", r6("roc_auc").alias("roc_auc"))


@query("multi_sort", sql(REPORTS, body="""
SELECT bug_id, bug_severity, price FROM reports ORDER BY bug_severity NULLS FIRST, price DESC, bug_id"""))
def multi_sort(spark, sf):
    return (
        reports(spark, sf)
        .select("bug_id", "bug_severity", "price")
        .orderBy(F.asc_nulls_first("bug_severity"), F.desc("price"), "bug_id")
    )


@query("limit_n", sql(REPORTS, body="""
SELECT bug_id, price FROM reports ORDER BY price DESC, bug_id LIMIT 100"""))
def limit_n(spark, sf):
    return dd.first_rows(
        reports(spark, sf).select("bug_id", "price"), [F.desc("price"), F.asc("bug_id")], 100
    )


@query("extreme_values", """
SELECT max(n_chars) AS longest, min(n_chars) AS shortest, max(length(text)) AS longest_text FROM documents""")
def extreme_values(spark, sf):
    return table(spark, sf, "documents").agg(
        F.max("n_chars").alias("longest"),
        F.min("n_chars").alias("shortest"),
        F.max(F.length("text")).cast("long").alias("longest_text"),
    )


@query("row_index", sql(SCORED, body="""
SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS idx FROM scored"""))
def row_index(spark, sf):
    ranked = ordered_rank(scored(spark, sf).select("id", "model"), "id", ["model"])
    return ranked.select("id", "model", (F.col("rank") - 1).alias("idx"))


# --- set operations ---


@query("set_intersect", """
SELECT doc_id AS id FROM labels INTERSECT SELECT vec_id FROM embeddings""")
def set_intersect(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return a.intersect(table(spark, sf, "embeddings").select("vec_id"))


@query("set_except", """
SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events""")
def set_except(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return a.subtract(table(spark, sf, "events").select("user_id"))


@query("union_all", """
SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents
UNION ALL SELECT conv_id, text, NULL, role FROM conversations
UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark""")
def union_all(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return d.unionByName(c, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)


@query("label_union", sql(DOCS, JUDGED, body="""
SELECT DISTINCT l AS label FROM (SELECT binary_severity AS l FROM judged UNION ALL SELECT code FROM judged) ORDER BY 1"""))
def label_union(spark, sf):
    j = judged(spark, sf)
    true = j.select(F.col("binary_severity").alias("label"))
    pred = j.select(missing_to_failed(F.col("severity_pred")).alias("label"))
    return true.union(pred).distinct().orderBy("label")
