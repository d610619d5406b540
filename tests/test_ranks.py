import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagedeck.operators import dedup as dd
from triagedeck.operators import metrics as mt
from triagedeck.operators import ranks as rk


def md5_rank(ids, seed):
    order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
    return {i: n + 1 for n, i in enumerate(order)}


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, one group null, one with a single row."""
    rows = [(i, "hot") for i in range(2000)] + [(i, "b") for i in range(2000, 2900)]
    rows += [(i, None) for i in range(2900, 2999)] + [(2999, "single")]
    return spark.createDataFrame(rows, "id long, g string").repartition(7)


def test_shuffled_rank_per_group(skewed):
    got = rk.shuffled_rank(skewed, "id", 5, ["g"], total="n").collect()
    assert len(got) == 3000
    for g in {r["g"] for r in got}:
        mine = {r["id"]: r["rank"] for r in got if r["g"] == g}
        assert mine == md5_rank(mine, 5)
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}


def test_shuffled_rank_limit(skewed):
    got = {r["id"]: r["rank"] for r in rk.shuffled_rank(skewed, "id", "s", limit=70).collect()}
    want = {i: n for i, n in md5_rank(range(3000), "s").items() if n <= 70}
    assert got == want


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(1)
    data = [(g, float(x) / 7, rng.randrange(9)) for g in "ab" for x in rng.sample(range(-5000, 5000), 800)]
    df = spark.createDataFrame(data, "g string, x double, n long").repartition(5)
    got = rk.running_totals(df, "x", {"c": "n"}, ["g"], descending).collect()
    for g in "ab":
        rows = sorted(((x, n) for h, x, n in data if h == g), reverse=descending)
        want = dict(zip([x for x, _ in rows], np.cumsum([n for _, n in rows])))
        assert {r["x"]: r["c"] for r in got if r["g"] == g} == want


def test_running_totals_stay_in_ranges(spark):
    """No window of the plan spans a whole group."""
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("x"))
    ranked = rk.ordered_rank(df, "x", ["g"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" not in line]
    assert windows and all("_b#" in line or "_at#" in line for line in windows)
    assert {r["rank"] for r in ranked.collect()} == set(range(1, 1001))


def test_one_shuffle_of_the_rows(spark):
    """Join and window share the partitioning: the rows themselves are exchanged once."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
        plan = rk.shuffled_rank(df, "id", 0, ["y"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(_at#" in x for x in exchanges) == 2  # rows, offsets


def test_one_heavy_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    values = rk.value_table(df, "x")
    got = rk.exact_quantiles(values, {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    x = np.array([1.0] * 1500 + [float(i) for i in range(1500, 3000)])
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.9])))


def test_describe_small_and_empty_spread(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 5), (None, 7)], "g string, x long")
    got = {r["g"]: r for r in mt.describe(df, "x", ["g"]).collect()}
    assert got["a"]["mean"] == pytest.approx(7 / 3) and got["a"]["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert got["a"]["q50"] == 2 and got["b"]["std"] is None and got[None]["max"] == 7


def test_first_per_key_keeps_the_whole_row(spark):
    rows = [(1, 5, "late", None), (1, 2, None, 1.0), (2, 1, "x", 2.0), (None, 3, "n", 3.0), (None, 4, "m", 4.0)]
    df = spark.createDataFrame(rows, "k long, at long, t string, v double")
    got = {tuple(r) for r in dd.first_per_key(df, ["k"], ["at"]).collect()}
    assert got == {(1, 2, None, 1.0), (2, 1, "x", 2.0), (None, 3, "n", 3.0)}


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    assert tuple(dd.has_duplicates(df, ["k"]).first()) == (1, 1)
    assert [tuple(r) for r in dd.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]


def test_best_per_group_tie(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 1, 0.5), ("a", 2, 0.4), ("a", 0, None)], "g string, run long, m double")
    assert dd.best_per_group(df, ["g"], "m", "run").first()["run"] == 1
