import json

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triagedeck.session import fresh_folder
from triagedeck.sources import embeddings as em
from triagedeck.sources import reports as rd
from triagedeck.sources import sinks as sk
from triagedeck.streaming import jobs


def write_text(spark, path, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_json_lines_drop_broken_rows(spark):
    path = fresh_folder(spark, "t")
    write_text(spark, path, '{"_id": "a", "bug_id": 1, "description": "x"}', "{broken", '{"bug_id": 2}')
    assert [r["bug_id"] for r in rd.read_json_lines(spark, path).orderBy("bug_id").collect()] == [1, 2]


def test_parse_lines(spark):
    lines = [
        {"_id": 1, "bug_id": 1, "bug_severity": "major", "description": [" see", "http://x.y "]},
        {"_id": 2, "bug_id": 2, "bug_severity": "normal", "description": "dropped"},
        {"_id": 3, "bug_id": 3, "bug_severity": "minor", "description": " \n"},
        {"_id": 4, "bug_id": 4, "bug_severity": "minor", "description": "ok"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("nonsense",)], "value string")
    got = {r["bug_id"]: (r["severity"], r["description"]) for r in rd.parse_report_lines(df).collect()}
    assert got == {1: (1, "see URL"), 4: (0, "ok")}


def test_csv_keeps_quotes_and_newlines(spark):
    path = fresh_folder(spark, "csv")
    row = (1, "major", 1, 'say "hi",\nthen stop', "x")
    rd.write_csv(spark.createDataFrame([row], rd.REPORT), path)
    assert tuple(rd.read_csv(spark, path).first()) == row


def test_predictions_from_lines_and_arrays(spark):
    path = fresh_folder(spark, "p")
    write_text(spark, f"{path}/a", '{"bug_id": 1, "severity_pred": 0}', "", '[{"bug_id": 2}, {"bug_id": 3}]')
    assert sorted(r["bug_id"] for r in rd.read_predictions(spark, path, glob="*.txt").collect()) == [1, 2, 3]


def test_earliest_chunk_wins(spark):
    chunks = spark.createDataFrame([(1, [2.0], 1), (1, [1.0], 0), (2, [3.0], 1)], "k long, v array<double>, chunk int")
    assert {r["k"]: r["v"] for r in em.merge_chunks(chunks, "k").collect()} == {1: [1.0], 2: [3.0]}


def test_feature_width(spark):
    ok = spark.createDataFrame([("tr", [1.0]), ("val", [2.0])], "split string, v array<double>")
    assert sk.check_width(ok, "v") is ok
    bad = spark.createDataFrame([("tr", [1.0]), ("val", [2.0, 3.0])], "split string, v array<double>")
    with pytest.raises(ValueError):
        sk.check_width(bad, "v")


def test_existing_split_sets_are_reused(spark):
    path = fresh_folder(spark, "s")
    splits = spark.createDataFrame([(1, "tr"), (2, "val")], "bug_id long, split string")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "bug_id long, t string")
    assert sk.write_split_sets(first, splits, path, "bug_id") is True
    assert sk.write_split_sets(first.withColumn("t", F.lit("new")), splits, path, "bug_id") is False
    assert {r["t"] for r in spark.read.parquet(path).collect()} == {"a", "b"}


def test_metrics_record(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, -1)], "t int, p int")
    row = sk.metrics_record(df, "t", "p").first()
    assert row["confusion_matrix"] == [[0, 0, 0], [0, 1, 1], [1, 0, 1]]
    assert row["f1"] == pytest.approx([0.0, 2 / 3, 0.5])


def test_stream_counts_continue_on_the_same_checkpoint(spark):
    docs = spark.createDataFrame([(1, 0, "aa bb aa"), (2, 1, "bb")], "id long, y int, t string")
    more = spark.createDataFrame([(3, 0, "aa")], docs.schema)
    source, sink, check = (fresh_folder(spark, n) for n in ("src", "sink", "check"))
    for part in (docs, more):
        part.coalesce(1).write.mode("append").parquet(source)
        jobs.run_nb_counts(jobs.stream_folder(spark, source, docs), "t", "y", sink, check)
    got = {(r["label"], r["term"]): r["n"] for r in jobs.latest_counts(spark, sink).collect()}
    assert got == {(0, "aa"): 3, (0, "bb"): 1, (1, "bb"): 1}


def test_epoch_leaves_when_closed(spark):
    rows = [("2024-01-01 10:00:00", "a", 1.0, 1, 1), ("2024-01-01 11:00:00", "a", 2.0, 0, 1), ("2024-01-03 00:00:00", "a", 5.0, 1, 1)]
    df = spark.createDataFrame(rows, "at string, run string, loss double, prediction int, binary_severity int").withColumn("ts", F.to_timestamp("at")).drop("at")
    source, sink, check = (fresh_folder(spark, n) for n in ("src", "sink", "check"))
    df.coalesce(1).write.parquet(source)
    jobs.run_epoch_metrics(jobs.stream_folder(spark, source, df), "ts", "1 day", "1 hour", "run", sink, check)
    got = spark.read.parquet(sink).collect()
    assert [(r["n_rows"], r["loss_sum"], r["n_right"]) for r in got] == [(2, 3.0, 1)]


def test_resume_override(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (2, "2024-01-01")], "id long, at string")
    done = spark.createDataFrame([(1,)], "id long")
    for override, want in ((False, [2]), (True, [1, 2])):
        source, sink, check = (fresh_folder(spark, n) for n in ("src", "sink", "check"))
        df.write.parquet(source)
        jobs.run_resume(jobs.stream_folder(spark, source, df), "id", done, sink, check, override)
        assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == want


def test_resume_over_a_long_history_in_any_order(spark):
    """Years apart and out of order, in several batches and from two checkpoints: once per key, none lost."""
    parts = [[(1, "2024-06-01"), (2, "2021-01-01")], [(3, "2019-05-05"), (1, "2020-01-01")], [(2, "2030-01-01"), (4, "1999-01-01"), (4, "1999-01-01")]]
    source, sink, check = (fresh_folder(spark, n) for n in ("src", "sink", "check"))
    for part in parts:
        df = spark.createDataFrame(part, "id long, at string")
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.run_resume(jobs.stream_folder(spark, source, df, 1), "id", None, sink, check)
    jobs.run_resume(jobs.stream_folder(spark, source, df, 1), "id", None, sink, fresh_folder(spark, "check"))
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4]


def _forget_last_commit(check):
    commits = Path(check) / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()


def test_a_replayed_batch_changes_nothing(spark):
    docs = spark.createDataFrame([(1, 0, "aa bb aa"), (2, 1, "bb")], "id long, y int, t string")
    source, sink, check = (fresh_folder(spark, n) for n in ("src", "sink", "check"))
    ids_sink, ids_check = fresh_folder(spark, "sink"), fresh_folder(spark, "check")
    for _ in range(2):
        docs.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        jobs.run_nb_counts(jobs.stream_folder(spark, source, docs, 1), "t", "y", sink, check)
        jobs.run_resume(jobs.stream_folder(spark, source, docs, 1), "id", None, ids_sink, ids_check)
        got = {(r["label"], r["term"]): r["n"] for r in jobs.latest_counts(spark, sink).collect()}
        assert got == {(0, "aa"): 4, (0, "bb"): 2, (1, "bb"): 2}
        assert sorted(r["id"] for r in spark.read.parquet(ids_sink).collect()) == [1, 2]
        _forget_last_commit(check)
        _forget_last_commit(ids_check)


def test_predictions_of_every_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"bug_id": 1, "severity_pred": 1.0}\n\n{"bug_id": 2, broken\n{"bug_id": 3}\n')
    (tmp_path / "b.json").write_text('[\n  {\n "bug_id": 4,\n "binary_severity": 1\n },\n {"bug_id": 5}\n]\n')
    (tmp_path / "c.json").write_text('[{"bug_id": 6}, {"bug_id": 7}]\n[{"bug_id": 8}]\n')
    got = rd.read_predictions(spark, str(tmp_path), keep_path=True).collect()
    assert sorted((r["bug_id"], r["path"][-6]) for r in got) == [(1, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, "c"), (8, "c")]
    bad = rd.rejected_predictions(spark, str(tmp_path)).collect()
    assert [(r["path"][-6:], r["value"]) for r in bad] == [("a.json", '{"bug_id": 2, broken')]


def test_rejected_lines_keep_their_file(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"bug_id": 1}\n{"bug_id": "one"}\n\nnot json\n')
    assert rd.read_json_lines(spark, str(tmp_path)).count() == 1
    bad = rd.rejected_lines(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-6:], r["split"], r["value"]) for r in bad) == [("x.json", 0, "not json"), ("x.json", 0, '{"bug_id": "one"}')]
