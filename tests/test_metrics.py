import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagedeck.functions import numbers as nx
from triagedeck.operators import curves as cv
from triagedeck.operators import metrics as mt


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, -1)], "t int, p int")
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in mt.confusion_matrix(df, "t", "p").collect()}
    order = (-1, 0, 1)
    assert [[cells[a, b] for b in order] for a in order] == [[0, 0, 0], [0, 1, 1], [1, 0, 1]]
    assert sum(cells.values()) == df.count()


def test_totals(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 4, "t int, p int")
    got = {(r["true_label"], r["pred_label"]): r["pct"] for r in mt.confusion_totals(df, "t", "p").collect()}
    assert got[0, 0] == 37.5 and got[0, None] == 75 and got[None, 1] == 80 and got[None, None] == 87.5


def test_undefined_scores_are_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (0, -2)], "t int, p int")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in mt.class_scores(df, "t", "p").collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), -2: (0, 0, 0)}


def test_half_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(nx.rounded_label(F.col("x"))).collect()] == [0, 2, 2]


def test_cross_entropy_floor(spark):
    got = spark.range(1).select(nx.cross_entropy(F.lit(1), F.lit(0.0)).alias("v")).first()["v"]
    assert got == 100.0


@pytest.mark.parametrize("ties", [5, 100_000])
def test_auc_is_the_rank_statistic(spark, ties):
    rng = random.Random(ties)
    data = [(m, rng.randrange(ties) / ties, rng.randrange(2)) for m in ("hot",) * 900 + ("b",) * 60]
    df = spark.createDataFrame(data, "m string, s double, y int").repartition(4)
    got = {r["m"]: r["auc"] for r in cv.auc(df, "y", "s", ["m"]).collect()}
    for m in ("hot", "b"):
        pos = np.array([s for g, s, y in data if g == m and y == 1])
        neg = np.array([s for g, s, y in data if g == m and y == 0])
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[m] == pytest.approx(wins / (len(pos) * len(neg)))


def test_best_threshold(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.6), (1, 0.6)], "y int, p double")
    got = cv.best_threshold(df, "y", "p").first()
    assert (got["threshold"], got["accuracy"]) == (0.6, 1.0)


def test_predicting_nothing_can_be_best(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("a", 0, 0.8), ("a", 1, 0.1)], "m string, y int, p double")
    got = cv.best_threshold(df, "y", "p", ["m"]).first()
    assert (got["threshold"], got["accuracy"]) == (float("inf"), pytest.approx(2 / 3))
    row = cv.run_summary(df, "y", "p", ["m"]).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["f1_severe"]) == (2, 0, 1, 0, 0.0)


@pytest.mark.parametrize("rule, want", [("gain", 3), ("score", 4)])
def test_early_stop_rules_differ_on_equal_losses(spark, rule, want):
    rows = [("r", e, x) for e, x in enumerate([1.0, 0.5, 0.5, 0.6, 0.7])]
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    got = cv.early_stop(df, ["run"], "epoch", "loss", 2, 0.0, rule).first()
    assert (got["stop_epoch"], got["best_loss"]) == (want, 0.5)


def test_representatives_include_empty_cells(spark):
    df = spark.createDataFrame([(i, 0, 0, "t") for i in range(9)] + [(20, 1, 0, "u")], "id long, y int, p int, t string")
    got = {(r["true_label"], r["pred_label"]): [s["id"] for s in r["samples"]] for r in mt.representatives(df, "y", "p", "id", 3, ["t"]).collect()}
    assert got == {(0, 0): [0, 1, 2], (1, 0): [20], (0, 1): [], (1, 1): []}


def test_pooling(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]])], "k long, s array<array<double>>")
    values = lambda how: [r["value"] for r in mt.pool_vectors(df, "k", "s", how).orderBy("dim").collect()]
    assert values("mean") == [2.0, 4.0] and values("sum") == [4.0, 8.0] and values("first") == [1.0, 2.0]


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("b", 0, 0.1), ("b", 1, 0.4)], "m string, y int, p double")
    assert {r["m"]: r["auc"] for r in cv.auc(df, "y", "p", ["m"]).collect()} == {"a": None, "b": 1.0}
    assert {r["m"]: r["auc"] for r in cv.run_summary(df, "y", "p", ["m"]).collect()} == {"a": None, "b": 1.0}
    points = cv.roc_points(df.filter("m = 'a'"), "y", "p", ["m"]).collect()
    assert {r["fpr"] for r in points} == {None, 0.0}


def test_curve_meets_its_totals_by_range(spark):
    """One join, on (group, range), and one shuffle of the rows: a group with most scores is spread."""
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.rand(3).alias("s"),
        F.when(F.col("id") % 20 > 0, "hot").alias("g"),
    )
    curve = cv._curve(cv._counts(df, "y", "s", ["g"]), ["g"])
    above, join, _ = curve._jdf.queryExecution().executedPlan().toString().partition("Join [")
    assert join and above.count("Exchange") == 1 and "Exchange hashpartitioning(_at" in above
    assert {r["g"] for r in cv.auc(df, "y", "s", ["g"]).collect()} == {"hot", None}
    assert {(r["n_pos"], r["n_neg"]) for r in curve.filter("g = 'hot'").collect()} == {(200, 180)}
