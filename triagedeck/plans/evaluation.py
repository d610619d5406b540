"""Aggregations, curves and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import missing_to_failed
from ..operators import curves as cv
from ..operators import metrics as mt
from ..operators import search as se
from ..operators.splits import stratified_split
from .base import (
    DOCS,
    JUDGED,
    REPORTS,
    RESULTS,
    SCORED,
    SPLIT,
    STEPS,
    docs,
    judged,
    query,
    r6,
    reports,
    results,
    scored,
    sql,
    steps,
    table,
    texts,
)
from .text import tokens_sql

# --- counts and profiles ---


@query("value_counts", sql(REPORTS, body="SELECT bug_severity, count(*) AS n FROM reports GROUP BY bug_severity"))
def value_counts(spark, sf):
    return mt.value_counts(reports(spark, sf), "bug_severity")


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("split_severity_counts", sql(DOCS, SPLIT, body="""
SELECT split, binary_severity, count(*) AS n FROM sdocs GROUP BY split, binary_severity"""))
def split_severity_counts(spark, sf):
    s = stratified_split(docs(spark, sf).select("bug_id", "binary_severity"), "bug_id", "binary_severity")
    return s.groupBy("split", "binary_severity").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_table", sql(DOCS, SPLIT, body="""
SELECT t.dataset, t.n_total, n_tr, n_val, n_test,
  CASE WHEN x_tr - floor(x_tr) = 0.5 THEN 2 * round(x_tr / 2) ELSE round(x_tr) END AS pct_tr,
  CASE WHEN x_val - floor(x_val) = 0.5 THEN 2 * round(x_val / 2) ELSE round(x_val) END AS pct_val,
  CASE WHEN x_test - floor(x_test) = 0.5 THEN 2 * round(x_test / 2) ELSE round(x_test) END AS pct_test
FROM (SELECT lang AS dataset, count(*) AS n_total FROM documents GROUP BY lang) t
JOIN (SELECT lang AS dataset, count_if(split = 'tr')::BIGINT AS n_tr, count_if(split = 'val')::BIGINT AS n_val, count_if(split = 'test')::BIGINT AS n_test
  FROM sdocs GROUP BY lang) c ON t.dataset = c.dataset
JOIN (SELECT s.lang AS ds, 100.0::DOUBLE * count_if(split = 'tr') / max(n) AS x_tr, 100.0::DOUBLE * count_if(split = 'val') / max(n) AS x_val,
  100.0::DOUBLE * count_if(split = 'test') / max(n) AS x_test
  FROM sdocs s JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d ON s.lang = d.lang GROUP BY s.lang) p ON p.ds = t.dataset"""))
def coverage_table(spark, sf):
    rows = stratified_split(
        docs(spark, sf).select("bug_id", "binary_severity", F.col("lang").alias("dataset")),
        "bug_id",
        "binary_severity",
    )
    totals = table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_total")
    )
    return mt.coverage_table(rows, totals, "dataset", "split", ("tr", "val", "test"))


@query("describe_tokens", f"""
WITH t AS (SELECT lang, len({tokens_sql('text')}) AS n FROM documents)
SELECT lang, count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max,
  round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75 FROM t GROUP BY lang""")
def describe_tokens(spark, sf):
    n = F.size(tx.tokens(F.col("text"))).cast("long")
    found = mt.describe(texts(spark, sf).select("lang", n.alias("n")), "n", ["lang"])
    return found.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("describe_prices", """
SELECT count(*) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem""")
def describe_prices(spark, sf):
    found = mt.describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("profile_columns", sql(REPORTS, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_non_null, CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS has_null FROM reports"
    for c in ("bug_id", "bug_severity", "short_desc", "bug_status", "reporter", "creation_ts", "price"))))
def profile_columns(spark, sf):
    return mt.profile_columns(reports(spark, sf))


# --- matrices and scores ---


def _coded(spark, sf):
    return judged(spark, sf).withColumn("code", missing_to_failed(F.col("severity_pred")))


@query("confusion_matrix", sql(DOCS, JUDGED, body="""
SELECT g.dataset, t.l AS true_label, p.l AS pred_label, count(j.bug_id) AS n
FROM (SELECT DISTINCT dataset FROM judged) g
JOIN (SELECT dataset, binary_severity AS l FROM judged UNION SELECT dataset, code FROM judged) t ON t.dataset = g.dataset
JOIN (SELECT dataset, binary_severity AS l FROM judged UNION SELECT dataset, code FROM judged) p ON p.dataset = g.dataset
LEFT JOIN judged j ON j.dataset = g.dataset AND j.binary_severity = t.l AND j.code = p.l GROUP BY ALL"""))
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(_coded(spark, sf), "binary_severity", "code", ["dataset"])


@query("confusion_totals", sql(DOCS, JUDGED, body="""
SELECT binary_severity AS true_label, code AS pred_label, CAST(grouping_id(binary_severity, code) AS INT) AS level, count(*) AS n,
  count_if(binary_severity = code)::BIGINT AS n_correct,
  round(CASE WHEN grouping_id(binary_severity, code) = 0 THEN 100.0 * count(*) / (SELECT count(*) FROM judged)
    ELSE 100.0 * count_if(binary_severity = code) / count(*) END, 6)::DOUBLE AS pct
FROM judged GROUP BY CUBE (binary_severity, code)"""))
def confusion_totals(spark, sf):
    found = mt.confusion_totals(_coded(spark, sf), "binary_severity", "code")
    return found.withColumn("pct", r6("pct"))


SCORES_SQL = """scores AS (SELECT l AS label, count_if(t = l)::BIGINT AS support, count_if(p = l)::BIGINT AS predicted, count_if(t = l AND p = l)::BIGINT AS tp
  FROM (SELECT binary_severity AS t, code AS p FROM judged), (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged) GROUP BY l)"""


@query("f1_per_class", sql(DOCS, JUDGED, SCORES_SQL, body="""
SELECT label, support, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END, 6) AS precision,
  round(CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END, 6) AS recall,
  round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (support + predicted) END, 6) AS f1 FROM scores"""))
def f1_per_class(spark, sf):
    found = mt.class_scores(_coded(spark, sf), "binary_severity", "code")
    return found.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("f1_averages", sql(DOCS, JUDGED, SCORES_SQL, body="""
SELECT round(avg(f), 6) AS f1_macro, round(sum(f * support) / sum(support), 6) AS f1_weighted
FROM (SELECT support, CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (support + predicted) END AS f FROM scores)"""))
def f1_averages(spark, sf):
    found = mt.f1_averages(_coded(spark, sf), "binary_severity", "code")
    return found.withColumns({c: r6(c) for c in ("f1_macro", "f1_weighted")})


@query("accuracy", sql(DOCS, JUDGED, body="""
SELECT dataset, round(avg(CASE WHEN binary_severity = code THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM judged GROUP BY dataset"""))
def accuracy(spark, sf):
    found = mt.accuracy(_coded(spark, sf), "binary_severity", "code", ["dataset"])
    return found.withColumn("accuracy", r6("accuracy"))


@query("epoch_loss", sql(SCORED, STEPS, body="""
SELECT r.*, b.batch_loss FROM
 (SELECT run, epoch, round(sum(loss) / count(*), 6) AS row_loss, count(*) AS n_rows FROM steps GROUP BY run, epoch) r
JOIN (SELECT run, epoch, round(avg(l), 6) AS batch_loss FROM (SELECT run, epoch, batch_id, max(loss) AS l FROM steps GROUP BY ALL) GROUP BY run, epoch) b
 ON r.run = b.run AND r.epoch = b.epoch"""))
def epoch_loss(spark, sf):
    """Per row, and per batch counted once. Batches come first: one pass yields both."""
    batches = steps(spark, sf).groupBy("run", "epoch", "batch_id").agg(
        F.max("loss").alias("b"), F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return batches.groupBy("run", "epoch").agg(
        r6(F.sum("s") / F.sum("n")).alias("row_loss"),
        F.sum("n").alias("n_rows"),
        r6(F.avg("b")).alias("batch_loss"),
    )


@query("mean_matrix", sql(SCORED, STEPS, body="""
, c AS (SELECT run, epoch, count_if(binary_severity = 0 AND probability < 0.05) AS a, count_if(binary_severity = 0 AND probability >= 0.05) AS b,
  count_if(binary_severity = 1 AND probability < 0.05) AS c, count_if(binary_severity = 1 AND probability >= 0.05) AS d FROM steps GROUP BY run, epoch)
SELECT run, 0 AS row, 0 AS col, round(avg(a), 6) AS mean FROM c GROUP BY run UNION ALL SELECT run, 0, 1, round(avg(b), 6) FROM c GROUP BY run
UNION ALL SELECT run, 1, 0, round(avg(c), 6) FROM c GROUP BY run UNION ALL SELECT run, 1, 1, round(avg(d), 6) FROM c GROUP BY run"""))
def mean_matrix(spark, sf):
    hit = F.col("probability") >= 0.05
    cell = lambda y, p: F.count_if((F.col("binary_severity") == y) & (hit if p else ~hit))
    matrices = steps(spark, sf).groupBy("run", "epoch").agg(
        F.array(F.array(cell(0, 0), cell(0, 1)), F.array(cell(1, 0), cell(1, 1))).alias("m")
    )
    return mt.mean_matrix(matrices, "m", ["run"]).withColumn("mean", r6("mean"))


@query("mean_over_folds", sql(SCORED, body="""
SELECT model, round(avg(m), 6) AS mean_value, count(*) AS n_folds FROM (SELECT model, user_id % 10 AS fold, max(score) AS m FROM scored GROUP BY ALL) GROUP BY model"""))
def mean_over_folds(spark, sf):
    folds = scored(spark, sf).groupBy("model", (F.col("user_id") % 10).alias("fold")).agg(F.max("score").alias("m"))
    return folds.groupBy("model").agg(r6(F.avg("m")).alias("mean_value"), F.count(F.lit(1)).alias("n_folds"))


@query("vector_min_max", """
SELECT CAST(i - 1 AS INT) AS dim, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max
FROM (SELECT i, embedding[i] AS v FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY i""")
def vector_min_max(spark, sf):
    return mt.vector_min_max(table(spark, sf, "embeddings"), "embedding")


@query("flatten_losses", sql(SCORED, STEPS, body="""
SELECT run, dataset_type, epoch, max(loss) AS loss FROM steps GROUP BY run, dataset_type, epoch"""))
def flatten_losses(spark, sf):
    """Nested per-epoch losses of two sets, back in long form."""
    per_epoch = steps(spark, sf).groupBy("run", "dataset_type", "epoch").agg(F.max("loss").alias("loss"))
    pairs = lambda t: F.array_sort(
        F.collect_list(F.when(F.col("dataset_type") == t, F.struct("epoch", "loss")))
    )
    nested = per_epoch.groupBy("run").agg(pairs("train").alias("train"), pairs("val").alias("val"))
    parts = [
        nested.select("run", F.lit(t).alias("dataset_type"), F.inline(t)) for t in ("train", "val")
    ]
    return parts[0].unionByName(parts[1])


# --- curves ---

CURVE = """cnt AS (SELECT model, score AS threshold, count_if(y = 1) AS p, count_if(y = 0) AS n FROM scored GROUP BY model, score),
curve AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS np, sum(n) OVER (PARTITION BY model) AS nn
  FROM cnt WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query("roc_points", sql(SCORED, CURVE, body="""
SELECT model, round(threshold, 6) AS threshold, round((fp / nn)::DOUBLE, 6) AS fpr, round((tp / np)::DOUBLE, 6) AS tpr FROM curve
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0, 0.0 FROM curve"""))
def roc_points(spark, sf):
    found = cv.roc_points(scored(spark, sf), "y", "score", ["model"])
    shown = F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).otherwise(F.col("threshold"))
    return found.select("model", shown.alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


AUC_SQL = """areas AS (SELECT model, (sum(n * (tp - p / 2.0::DOUBLE)) / (max(np) * max(nn)))::DOUBLE AS auc FROM curve GROUP BY model)"""


@query("auc", sql(SCORED, CURVE, AUC_SQL, body="SELECT model, round(auc, 6) AS auc FROM areas"))
def auc(spark, sf):
    return cv.auc(scored(spark, sf), "y", "score", ["model"]).withColumn("auc", r6("auc"))


BEST_SQL = """cand AS (SELECT model, threshold, tp + nn - fp AS ok, np + nn AS total FROM curve
  UNION ALL SELECT model, 'inf'::DOUBLE, max(nn), max(np + nn) FROM curve GROUP BY model),
best AS (SELECT model, threshold, (ok / total)::DOUBLE AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ok DESC, threshold DESC) AS rn FROM cand) WHERE rn = 1)"""


@query("best_threshold", sql(SCORED, CURVE, BEST_SQL, body="SELECT model, threshold, round(accuracy, 6) AS accuracy FROM best"))
def best_threshold(spark, sf):
    found = cv.best_threshold(scored(spark, sf), "y", "score", ["model"])
    return found.withColumn("accuracy", r6("accuracy"))


EPOCHS = "epochs AS (SELECT run, epoch, max(loss) AS loss FROM steps GROUP BY run, epoch)"


def _epochs(spark, sf):
    return steps(spark, sf).groupBy("run", "epoch").agg(F.max("loss").alias("loss"))


STOP = """num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM epochs),
walk(run, i, epoch, best, bad, stop) AS (
  SELECT run, i, epoch, loss::DOUBLE, 0, NULL::BIGINT FROM num WHERE i = 1
  UNION ALL SELECT n.run, n.i, n.epoch,
    CASE WHEN w.stop IS NULL AND {better} THEN n.loss ELSE w.best END,
    CASE WHEN w.stop IS NOT NULL THEN w.bad WHEN {better} THEN 0 ELSE w.bad + 1 END,
    CASE WHEN w.stop IS NOT NULL THEN w.stop WHEN NOT ({better}) AND w.bad + 1 >= 3 THEN n.epoch END
  FROM walk w JOIN num n ON n.run = w.run AND n.i = w.i + 1)
SELECT run, max(stop) AS stop_epoch, min(best) AS best_loss FROM walk GROUP BY run"""


def stop_sql(better: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SCORED, STEPS, EPOCHS]) + ",\n" + STOP.format(better=better)


@query("early_stop", stop_sql("(n.loss < w.best AND abs(n.loss - w.best) > 1.0)"))
def early_stop(spark, sf):
    return cv.early_stop(_epochs(spark, sf), ["run"], "epoch", "loss", 3, 1.0, "gain")


@query("early_stop_score", stop_sql("(NOT (-n.loss < -w.best + 0.0))"))
def early_stop_score(spark, sf):
    return cv.early_stop(_epochs(spark, sf), ["run"], "epoch", "loss", 3, 0.0, "score")


PARAMS = ["learning_rate", "lora_r", "prompt_id"]


def _trials(spark, sf):
    return se.results_to_trials(results(spark, sf), ["run"], "roc_auc", [*PARAMS, "quant"])


@query("parallel_axes", sql(SCORED, STEPS, RESULTS, body="""
SELECT parameter, choice, round(max(roc_auc), 6) AS best, count(*) AS n_trials,
  CAST(dense_rank() OVER (PARTITION BY parameter ORDER BY choice) - 1 AS INT) AS code FROM (
 SELECT 'learning_rate' AS parameter, learning_rate AS choice, roc_auc FROM results WHERE dataset_type = 'val'
 UNION ALL SELECT 'lora_r', lora_r, roc_auc FROM results WHERE dataset_type = 'val'
 UNION ALL SELECT 'prompt_id', prompt_id, roc_auc FROM results WHERE dataset_type = 'val') GROUP BY parameter, choice"""))
def parallel_axes(spark, sf):
    return cv.parallel_axes(_trials(spark, sf), "value", [*PARAMS, "quant"]).withColumn("best", r6("best"))


# --- run reports ---


@query("results_to_trials", sql(SCORED, STEPS, RESULTS, body="""
SELECT run, '{"learning_rate":"' || learning_rate || '","lora_r":"' || lora_r || '","prompt_id":"' || prompt_id || '"}' AS params,
  round(roc_auc, 6) AS value FROM results WHERE dataset_type = 'val'"""))
def results_to_trials(spark, sf):
    return _trials(spark, sf).select("run", F.to_json("params").alias("params"), r6("value").alias("value"))


@query("run_summary", sql(SCORED, CURVE, AUC_SQL, BEST_SQL, body="""
SELECT a.model, round(auc, 6) AS auc, b.threshold, round(b.accuracy, 6) AS accuracy,
  count_if(s.y = 0 AND s.score < b.threshold)::BIGINT AS tn, count_if(s.y = 0 AND s.score >= b.threshold)::BIGINT AS fp,
  count_if(s.y = 1 AND s.score < b.threshold)::BIGINT AS fn, count_if(s.y = 1 AND s.score >= b.threshold)::BIGINT AS tp,
  round(CASE WHEN 2 * count_if(s.y = 1 AND s.score >= b.threshold) + count_if(s.y = 0 AND s.score >= b.threshold) + count_if(s.y = 1 AND s.score < b.threshold) = 0 THEN 0
   ELSE 2.0::DOUBLE * count_if(s.y = 1 AND s.score >= b.threshold) / (2 * count_if(s.y = 1 AND s.score >= b.threshold) + count_if(s.y = 0 AND s.score >= b.threshold) + count_if(s.y = 1 AND s.score < b.threshold)) END, 6) AS f1_severe
FROM areas a JOIN best b ON a.model = b.model JOIN scored s ON s.model = a.model GROUP BY a.model, auc, b.threshold, b.accuracy"""))
def run_summary(spark, sf):
    found = cv.run_summary(scored(spark, sf), "y", "score", ["model"])
    return found.withColumns({c: r6(c) for c in ("auc", "accuracy", "f1_severe")})


@query("learning_curve_results", sql(SCORED, STEPS, RESULTS, body="""
, r AS (SELECT prompt_id AS classifier, lora_r::INT AS n_samples, avg(CASE WHEN dataset_type = 'train' THEN roc_auc END) AS val,
  avg(CASE WHEN dataset_type = 'val' THEN roc_auc END) AS test FROM results GROUP BY ALL)
SELECT classifier, n_samples, 'val' AS split, round(val, 6) AS auc FROM r UNION ALL SELECT classifier, n_samples, 'test', round(test, 6) FROM r"""))
def learning_curve_results(spark, sf):
    value = lambda t: F.when(F.col("dataset_type") == t, F.col("roc_auc"))
    rows = results(spark, sf).select(
        F.col("prompt_id").alias("classifier"),
        F.col("lora_r").cast("int").alias("n_samples"),
        value("train").alias("auc_val"),
        value("val").alias("auc_test"),
    )
    return se.learning_curve(rows).withColumn("auc", r6("auc"))
