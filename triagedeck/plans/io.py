"""Sources and sinks: a table is written in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nx
from ..functions import text as tx
from ..operators.features import binary_counts, term_counts
from ..operators.splits import stratified_split
from ..session import fresh_folder, materialise
from ..sources import embeddings as em
from ..sources import reports as rd
from ..sources import sinks as sk
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
    sql,
    steps,
    table,
)


def _raw_records(spark, sf):
    """Reports as raw records; every other description is a list of lines."""
    d = table(spark, sf, "documents")
    lines = F.to_json(F.split("text", "\n"))
    listed = F.when(F.col("doc_id") % 2 == 0, lines).otherwise(F.col("text"))
    severity = (
        F.when(F.col("lang") == "de", "normal").when(F.col("lang") == "fr", "blocker").when(F.col("lang") == "es", None).otherwise("minor")
    )
    return d.select(
        F.col("doc_id").cast("string").alias("_id"),
        F.col("doc_id").alias("bug_id"),
        severity.alias("bug_severity"),
        listed.alias("description"),
        F.col("source").alias("product"),
    )


@query("src_jsonl", """
SELECT doc_id AS bug_id, CASE lang WHEN 'de' THEN 'normal' WHEN 'fr' THEN 'blocker' WHEN 'es' THEN NULL ELSE 'minor' END AS bug_severity,
  CASE WHEN doc_id % 2 = 0 THEN regexp_replace(replace(text, chr(10), ' '), '^[\\s]+|[\\s]+$', '', 'g') ELSE text END AS description, source AS product FROM documents""")
def src_jsonl(spark, sf):
    path = fresh_folder(spark, "jsonl")
    sk.write_json(_raw_records(spark, sf), path)
    read = rd.read_json_lines(spark, path)
    return read.select(
        "bug_id", "bug_severity", rd.list_or_text(F.col("description")).alias("description"), "product"
    )


@query("src_json_array", sql(DOCS, body="SELECT bug_id, lang AS bug_severity, binary_severity, description FROM docs"))
def src_json_array(spark, sf):
    path = fresh_folder(spark, "json-array")
    records = docs(spark, sf).select(
        "bug_id", F.to_json(F.struct("bug_id", F.col("lang").alias("bug_severity"), "binary_severity", "description")).alias("r")
    )
    # One array per range of ids: every file has a bounded size.
    arrays = records.groupBy(F.expr("bug_id div 500").alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return rd.read_json_array(spark, path).select(
        "bug_id", "bug_severity", "binary_severity", "description"
    )


@query("src_csv_roundtrip", sql(DOCS, body="SELECT bug_id, lang AS bug_severity, binary_severity, description, description AS stemmed_description FROM docs"))
def src_csv_roundtrip(spark, sf):
    path = fresh_folder(spark, "csv")
    rows = docs(spark, sf).select(
        "bug_id",
        F.col("lang").alias("bug_severity"),
        "binary_severity",
        "description",
        F.col("description").alias("stemmed_description"),
    )
    rd.write_csv(rows, path)
    return rd.read_csv(spark, path)


@query("src_split_explode", sql(DOCS, SPLIT, body="SELECT bug_id, split FROM sdocs"))
def src_split_explode(spark, sf):
    """Split objects are written in parts of bounded size; their ids are read as one table."""
    path = fresh_folder(spark, "split")
    split = stratified_split(docs(spark, sf).select("bug_id", "binary_severity"), "bug_id", "binary_severity")
    parts = split.groupBy(F.expr("bug_id div 1000").alias("part")).agg(
        *[
            F.collect_list(F.when(F.col("split") == s, F.col("bug_id"))).alias(s)
            for s in ("tr", "val", "test")
        ]
    )
    sk.write_json(parts.drop("part"), path)
    return rd.read_split(spark, path)


@query("src_predictions_glob", sql(DOCS, JUDGED, body="SELECT bug_id, binary_severity, code AS severity_pred FROM judged"))
def src_predictions_glob(spark, sf):
    """Lines, one-line arrays and arrays laid out over many lines, with broken lines between the good ones."""
    path = fresh_folder(spark, "predictions")
    j = judged(spark, sf).select("bug_id", "binary_severity", "severity_pred")
    good = j.filter("binary_severity = 1").select(F.to_json(F.struct("*")).alias("value"))
    broken = good.select(F.expr("left(value, length(value) - 3)").alias("value"))
    good.union(broken).write.text(f"{path}/lines")
    arrays = j.filter("binary_severity = 0").groupBy(F.expr("bug_id div 100").alias("part")).agg(
        F.collect_list(F.to_json(F.struct("bug_id", "binary_severity", "severity_pred"))).alias("r")
    )
    flat, tall = F.array_join("r", ","), F.array_join("r", ",\n  ")
    value = F.when(F.col("part") % 2 == 0, F.concat(F.lit("["), flat, F.lit("]\n\n"))).otherwise(
        F.concat(F.lit("[\n  "), tall, F.lit("\n]"))
    )
    arrays.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    read = rd.read_predictions(spark, path, glob="*.txt")
    return read.select(
        "bug_id", "binary_severity", nx.missing_to_failed(F.col("severity_pred")).alias("severity_pred")
    )


@query("src_rejected", sql(DOCS, body="SELECT count(*) AS n_good, count(*) AS n_rejected, count(*) AS n_lines FROM docs"))
def src_rejected(spark, sf):
    """As many broken lines as good ones are told apart and counted."""
    path = fresh_folder(spark, "rejected")
    rows = docs(spark, sf).select(F.to_json(F.struct("bug_id", "description")).alias("value"))
    rows.union(rows.select(F.expr("left(value, length(value) - 1)"))).write.text(path)
    good = rd.read_json_lines(spark, path).agg(F.count(F.lit(1)).alias("n_good"))
    bad = rd.rejected_lines(spark, path).agg(F.count(F.lit(1)).alias("n_rejected"), F.count_distinct("value").alias("n_lines"))
    return good.withColumn("_b", bad.select(F.struct("*")).scalar()).select("n_good", "_b.*")


def _folder():
    """Runs with the same parameters share a folder."""
    return F.concat(F.lit("run_"), (F.col("run") % 20).cast("string"))


def _write_runs(spark, sf):
    root = fresh_folder(spark, "runs")
    rows = steps(spark, sf).select(
        _folder().alias("name"),
        "bug_id",
        "binary_severity",
        F.col("dataset_type").alias("answer"),
        F.col("loss").cast("double").alias("severity_pred"),
    )
    rows.write.partitionBy("name").json(f"{root}/predictions")
    params = F.create_map(F.lit("learning_rate"), "learning_rate", F.lit("lora_r"), "lora_r")
    folders = results(spark, sf).groupBy(_folder().alias("name")).agg(
        F.min("learning_rate").alias("learning_rate"), F.min("lora_r").alias("lora_r")
    )
    folders.select("name", F.to_json(params).alias("value")).write.partitionBy("name").text(
        f"{root}/parameters"
    )
    return root


@query("src_runs_with_params", sql(SCORED, STEPS, RESULTS, body="""
SELECT 'name=run_' || s.run % 20 AS run, s.bug_id, s.dataset_type AS answer, s.loss::DOUBLE AS severity_pred, r.learning_rate, r.lora_r
FROM steps s JOIN (SELECT DISTINCT run % 20 AS folder, learning_rate, lora_r FROM results) r ON r.folder = s.run % 20"""))
def src_runs_with_params(spark, sf):
    root = _write_runs(spark, sf)
    rows = rd.read_runs(spark, f"{root}/predictions", f"{root}/parameters")
    return rows.select(
        "run", "bug_id", "answer", "severity_pred", F.col("params")["learning_rate"].alias("learning_rate"), F.col("params")["lora_r"].alias("lora_r")
    )


NAMES = """names AS (SELECT page_id, '/data/X_full_' || CASE page_id % 3 WHEN 0 THEN 'tr' WHEN 1 THEN 'val' ELSE 'test' END || '_'
  || CASE WHEN page_id % 2 = 0 THEN 'nb_bino' WHEN page_id % 5 = 0 THEN 'nb_non_bino' ELSE 'svm_knn' END || CASE WHEN page_id % 7 = 0 THEN '_net.core_' ELSE '_eclipse_' END
  || page_id * 100 || '_samples_epoch_' || page_id % 9 || '.npy' AS path FROM pages)"""


@query("src_filename_meta", sql(NAMES, body="""
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'net.core' ELSE 'eclipse' END AS dataset, CASE WHEN page_id % 2 = 0 THEN 'nb_binary' WHEN page_id % 5 = 0 THEN 'nb_counts' ELSE 'svm_knn' END AS algorithm,
  (page_id * 100)::INT AS n_samples, (page_id % 9)::INT AS epoch, CASE page_id % 3 WHEN 0 THEN 'tr' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM names"""))
def src_filename_meta(spark, sf):
    p = F.col("page_id")
    split = F.when(p % 3 == 0, "tr").when(p % 3 == 1, "val").otherwise("test")
    group = F.when(p % 2 == 0, "nb_bino").when(p % 5 == 0, "nb_non_bino").otherwise("svm_knn")
    path = F.concat(
        F.lit("/data/X_full_"), split, F.lit("_"), group, F.when(p % 7 == 0, "_net.core_").otherwise("_eclipse_"),
        (p * 100).cast("string"),
        F.lit("_samples_epoch_"), (p % 9).cast("string"), F.lit(".npy"),
    )
    named = table(spark, sf, "pages").select("page_id", path.alias("path"))
    parts = rd.name_parts(F.col("path"), ["eclipse", "net.core"])
    return named.select("page_id", *[c.alias(n) for n, c in parts.items()])


@query("src_merge_embeddings", """
SELECT vec_id, chunk, dim::INT AS dim, round(v::DOUBLE, 6) AS value FROM (SELECT vec_id, CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS INT) AS chunk,
  unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)""")
def src_merge_embeddings(spark, sf):
    """Two overlapping chunks: the second holds every vector again. Whole vectors, a row per element."""
    path = fresh_folder(spark, "chunks")
    e = table(spark, sf, "embeddings")
    e.filter("label < 5").drop("label").write.parquet(f"{path}/chunk=0")
    e.drop("label").write.parquet(f"{path}/chunk=1")
    merged = em.merge_chunks(em.read_chunks(spark, path), "vec_id")
    cells = merged.select("vec_id", "chunk", F.posexplode("embedding").alias("dim", "v"))
    return cells.select("vec_id", "chunk", "dim", r6(F.col("v").cast("double")).alias("value"))


@query("src_aggr_runs", sql(SCORED, STEPS, RESULTS, body="""
SELECT 'name=run_' || s.run % 20 AS run, s.epoch, max(s.loss)::DOUBLE AS loss, s.run::DOUBLE AS f1, max(r.learning_rate) AS learning_rate FROM steps s
JOIN results r ON r.run = s.run GROUP BY s.run, s.epoch"""))
def src_aggr_runs(spark, sf):
    """One line per run, with the run's few epochs as an array."""
    root = _write_runs(spark, sf)
    epochs = steps(spark, sf).groupBy("run", "epoch").agg(
        F.max("loss").cast("double").alias("loss"), F.first("run").cast("double").alias("f1")
    )
    lines = epochs.groupBy("run").agg(
        F.to_json(F.collect_list(F.struct("epoch", "loss", "f1"))).alias("value")
    )
    lines.select(_folder().alias("name"), "value").write.partitionBy("name").text(f"{root}/metrics")
    found = rd.read_run_metrics(spark, f"{root}/metrics", f"{root}/parameters")
    return found.select("run", "epoch", "loss", "f1", F.col("params")["learning_rate"].alias("learning_rate"))


@query("src_parse_lines", """
SELECT CAST(doc_id AS VARCHAR) AS _id, doc_id AS bug_id, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS severity,
  regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ') ELSE text END, '^[\\s]+|[\\s]+$', '', 'g') AS description
FROM documents WHERE lang <> 'de'""")
def src_parse_lines(spark, sf):
    path = fresh_folder(spark, "lines")
    sk.write_json(_raw_records(spark, sf), path)
    return rd.parse_report_lines(spark.read.text(path))


# --- sinks ---


@query("snk_json", sql(REPORTS, body="SELECT bug_id, bug_severity, reporter FROM reports"))
def snk_json(spark, sf):
    path = fresh_folder(spark, "json")
    sk.write_json(reports(spark, sf).select("bug_id", "bug_severity", "reporter"), path)
    return spark.read.schema("bug_id long, bug_severity string, reporter long").json(path)


def _write_features(spark, sf):
    path = fresh_folder(spark, "features")
    counts = materialise(term_counts(docs(spark, sf), "bug_id", "description"), "counts")
    for name, rows in (("nb_bino", binary_counts(counts)), ("nb_non_bino", counts)):
        sk.write_feature_set(rows, path, name, -1)
    return path


@query("snk_feature_sets", sql(DOCS, body="""
, t AS (SELECT bug_id, unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs),
b AS (SELECT bug_id, term, count(*) AS n FROM t GROUP BY ALL)
SELECT feature_set, -1 AS n_samples, count(*) AS n_rows, CAST(sum(CASE WHEN feature_set = 'nb_bino' THEN 1 ELSE n END) AS BIGINT) AS total
FROM b, (SELECT unnest(['nb_bino', 'nb_non_bino']) AS feature_set) GROUP BY feature_set"""))
def snk_feature_sets(spark, sf):
    stored = spark.read.parquet(_write_features(spark, sf))
    return stored.groupBy("feature_set", "n_samples").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total")
    )


@query("src_feature_sets", sql(DOCS, body="""
, t AS (SELECT bug_id, unnest(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}')) AS term FROM docs)
SELECT bug_id, term, count(*) AS n FROM t GROUP BY ALL"""))
def src_feature_sets(spark, sf):
    path = _write_features(spark, sf)
    return sk.read_feature_set(spark, path, "nb_non_bino", -1).select("bug_id", "term", "n")


@query("snk_split_sets", sql(DOCS, SPLIT, body=f"""
SELECT bug_id, split, 'Report: ' || description AS input, CAST(len(regexp_extract_all(description, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS INT) AS n_tokens FROM sdocs"""))
def snk_split_sets(spark, sf):
    path = fresh_folder(spark, "sets")
    d = docs(spark, sf)
    split = stratified_split(d.select("bug_id", "binary_severity"), "bug_id", "binary_severity")
    prompt = tx.fill_template("Report: $input", input=F.col("description"))
    rows = d.select("bug_id", prompt.alias("input"), F.size(tx.tokens(F.col("description"))).alias("n_tokens"))
    for _ in range(2):  # the second call finds the target and leaves it
        sk.write_split_sets(rows, split.select("bug_id", "split"), path, "bug_id")
    return spark.read.parquet(path).select("bug_id", "split", "input", "n_tokens")


@query("snk_metrics", sql(DOCS, JUDGED, body="""
, labs AS (SELECT binary_severity AS l FROM judged UNION SELECT code FROM judged),
matrix AS (SELECT t.l, '[' || string_agg((SELECT count(*) FROM judged j WHERE j.binary_severity = t.l AND j.code = p.l), ', ' ORDER BY p.l) || ']' AS confusion_row
  FROM labs t CROSS JOIN labs p GROUP BY t.l),
f AS (SELECT l, 2.0 * sum(CASE WHEN binary_severity = l AND code = l THEN 1 ELSE 0 END)
  / (sum(CASE WHEN binary_severity = l THEN 1 ELSE 0 END) + sum(CASE WHEN code = l THEN 1 ELSE 0 END)) AS f1 FROM judged, labs GROUP BY l)
SELECT CAST(row_number() OVER (ORDER BY l) - 1 AS INT) AS label_no, confusion_row, round(f1::DOUBLE, 6) AS f1 FROM matrix JOIN f USING (l)"""))
def snk_metrics(spark, sf):
    path = fresh_folder(spark, "metrics")
    j = judged(spark, sf).withColumn("code", nx.missing_to_failed(F.col("severity_pred")))
    sk.write_json(sk.metrics_record(j, "binary_severity", "code"), path)
    stored = spark.read.schema("confusion_matrix array<array<long>>, f1 array<double>, written_at timestamp").json(path)
    labels = stored.select(F.posexplode(F.arrays_zip("confusion_matrix", "f1")).alias("label_no", "s"))
    return labels.select(
        "label_no", F.col("s.confusion_matrix").cast("string").alias("confusion_row"), r6("s.f1").alias("f1")
    )


@query("snk_run_manifest", sql(DOCS, body="""
SELECT 'documents' AS run, CAST(count(*) AS VARCHAR) AS n_rows, '0' AS seed FROM docs"""))
def snk_run_manifest(spark, sf):
    path = fresh_folder(spark, "manifest")
    sk.append_manifest(spark, path, "documents", {"n_rows": docs(spark, sf).count(), "seed": 0})
    stored = spark.read.schema("run string, params map<string,string>, written_at timestamp").json(path)
    return stored.select("run", F.col("params")["n_rows"].alias("n_rows"), F.col("params")["seed"].alias("seed"))
