from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagedeck.operators import joins as jn
from triagedeck.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1003).select(F.col("id").alias("bug_id"), (F.col("id") % 7 == 0).cast("int").alias("y")).repartition(5)


def test_split_is_disjoint_complete_and_stratified(rows):
    got = sp.stratified_split(rows, "bug_id", "y").collect()
    assert sorted(r["bug_id"] for r in got) == list(range(1003))
    n1 = len(range(0, 1003, 7))
    for y, n in ((1, n1), (0, 1003 - n1)):
        parts = Counter(r["split"] for r in got if r["y"] == y)
        tr = 7 * n // 10
        assert parts == {"tr": tr, "val": 2 * (n - tr) // 3, "test": n - tr - 2 * (n - tr) // 3}


def test_split_is_reproducible(rows):
    pick = lambda df: {r["bug_id"]: r["split"] for r in sp.stratified_split(df, "bug_id", "y", seed=3).collect()}
    assert pick(rows) == pick(rows.repartition(11))


def test_folds(rows):
    got = sp.stratified_kfold(rows, "bug_id", "y", 5, [0, 1]).collect()
    assert Counter(r["seed"] for r in got) == {0: 1003, 1: 1003}
    sizes = Counter((r["seed"], r["y"], r["fold"]) for r in got)
    for seed in (0, 1):
        for y in (0, 1):
            per_fold = [sizes[seed, y, f] for f in range(5)]
            assert max(per_fold) - min(per_fold) <= 1


def test_balanced_sample(rows):
    got = sp.balanced_sample(rows, "bug_id", "y", [0, 1]).collect()
    n1 = len(range(0, 1003, 7))
    assert Counter((r["epoch"], r["y"]) for r in got) == {(e, y): n1 for e in (0, 1) for y in (0, 1)}
    majority = [{r["bug_id"] for r in got if r["epoch"] == e and r["y"] == 0} for e in (0, 1)]
    assert majority[0] != majority[1]


def test_ladder_is_nested(rows):
    got = sp.sample_ladder(rows.select("bug_id"), "bug_id", [10, 50, -1]).collect()
    sets = {n: {r["bug_id"] for r in got if r["n_samples"] == n} for n in (10, 50, -1)}
    assert [len(sets[n]) for n in (10, 50, -1)] == [10, 50, 1003]
    assert sets[10] < sets[50] < sets[-1]


def test_chunks(spark):
    got = sp.chunk_ranges(spark.range(10).toDF("k"), "k", 3).orderBy("chunk").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 3), (3, 6), (6, 10)]


def test_groups(spark):
    got = sp.fixed_groups(spark.range(5).toDF("k"), "k", 2).orderBy("group_id").collect()
    assert [r["members"] for r in got] == [[0, 1], [2, 3], [4]]


def test_grid_has_every_combination(spark):
    studies = spark.createDataFrame([("a",), ("b",)], "study string")
    grid = sp.parameter_grid(studies, {"x": [1, 2], "z": ["p", "q", "r"]})
    assert grid.distinct().count() == 12
    assert sp.grid_sample(grid, ["study"], ["x", "z"], 4).groupBy("study").count().collect()[0]["count"] == 4


def test_first_split_wins(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "bug_id long")
    lists = spark.createDataFrame([(1, "test"), (1, "tr"), (2, "val"), (4, "tr")], "bug_id long, split string")
    got = {r["bug_id"]: r["split"] for r in jn.assign_split(rows, lists, "bug_id").collect()}
    assert got == {1: "tr", 2: "val"}


def test_backfill(spark):
    pred = spark.createDataFrame(
        [("e", "tr", "p1", 1, 0, 1), ("e", "tr", "p1", 1, 0, 0), ("e", "tr", "p2", 2, 1, 1)],
        "dataset string, split string, prompt string, bug_id long, y int, severity_pred int",
    )
    expected = spark.createDataFrame(
        [("e", "tr", 1, 0), ("e", "tr", 2, 1), ("m", "tr", 9, 1)], "dataset string, split string, bug_id long, y int"
    )
    full = jn.backfill_missing(pred, expected, ["dataset", "split"], "bug_id", "y", "prompt", ["severity_pred"])
    got = {(r["prompt"], r["bug_id"]): r["severity_pred"] for r in full.collect()}
    assert got == {("p1", 1): 0, ("p1", 2): -2, ("p2", 1): -2, ("p2", 2): 1}
    assert full.count() == 4
