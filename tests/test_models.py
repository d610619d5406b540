import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagedeck.functions.numbers import minkowski
from triagedeck.operators import classifiers as cl
from triagedeck.operators import features as ft
from triagedeck.operators import knn
from triagedeck.operators import naive_bayes as nb
from triagedeck.operators import search as se
from triagedeck.session import materialise

WORDS = ["alpha", "beta", "gamma", "delta", "eps"]


@pytest.fixture(scope="module")
def corpus(spark):
    """'common' stands in every training text; one scored text lacks it."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        y = i % 2
        words = ["common"] * rng.randrange(1, 4) + rng.choices(WORDS[: 3 + 2 * y], k=6)
        rows.append((i, y, "tr", " ".join(words)))
    rows += [(100, 0, "val", "alpha beta unseen"), (101, 1, "val", "common eps eps eps"), (102, 1, "val", "???")]
    df = spark.createDataFrame(rows, "bug_id long, y int, split string, text string")
    counts = materialise(ft.term_counts(df, "bug_id", "text", ["y", "split"]))
    return rows, df.select("bug_id", "y", "split"), counts


def dense(rows):
    terms = sorted({w for r in rows if r[2] == "tr" for w in r[3].split()})
    x = np.array([[r[3].split().count(t) for t in terms] for r in rows], dtype=float)
    train = np.array([r[2] == "tr" for r in rows])
    lo, hi = x[train].min(axis=0), x[train].max(axis=0)
    span = np.where(hi > lo, hi - lo, 1.0)
    scaled = np.where(hi > lo, (x - lo) / span, 0.0)
    return scaled, train, np.array([r[1] for r in rows])


def probs(spark_scored):
    return {r["bug_id"]: r["prob"] for r in spark_scored.collect()}


def fitted(corpus, moments=False):
    rows, docs, counts = corpus
    train = counts.filter("split = 'tr'")
    sizes = nb.class_sizes(docs.filter("split = 'tr'"), "y")
    return rows, docs, counts, train, sizes, nb.term_stats(train, sizes, "y", moments)


def expected(rows, log_likelihood):
    x, train, y = dense(rows)
    z = np.stack([log_likelihood(x, x[train], y[train], c) for c in (0, 1)], axis=1)
    return {r[0]: 1 / (1 + math.exp(a - b)) for r, (a, b) in zip(rows, z)}


def test_multinomial(corpus):
    rows, docs, counts, _, sizes, stats = fitted(corpus)
    got = probs(nb.score(nb.fit_multinomial(stats, sizes, 0.7), counts, docs, "bug_id"))

    def ll(x, tx, ty, c):
        s = tx[ty == c].sum(axis=0) + 0.7
        return math.log((ty == c).mean()) + x @ np.log(s / s.sum())

    assert got == pytest.approx(expected(rows, ll))


def test_bernoulli(corpus):
    rows, docs, counts, train, sizes, stats = fitted(corpus)
    model = nb.fit_bernoulli(train, stats, sizes, "y", 0.3, 0.2, nb.Prior(fit=False))
    got = probs(nb.score(model, counts, docs, "bug_id"))

    def ll(x, tx, ty, c):
        p = ((tx[ty == c] > 0.2).sum(axis=0) + 0.3) / ((ty == c).sum() + 0.6)
        b = x > 0.2
        return math.log(0.5) + b @ np.log(p) + (~b) @ np.log(1 - p)

    assert got == pytest.approx(expected(rows, ll))


def test_gaussian(corpus):
    rows, docs, counts, _, sizes, stats = fitted(corpus, moments=True)
    got = probs(nb.score(nb.fit_gaussian_terms(stats, sizes, 0.05), counts, docs, "bug_id"))

    def ll(x, tx, ty, c):
        m = tx[ty == c].mean(axis=0)
        v = tx[ty == c].var(axis=0) + 0.05 * tx.var(axis=0).max()
        return math.log((ty == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1)

    assert got == pytest.approx(expected(rows, ll))


@pytest.mark.parametrize("norm", [False, True])
def test_complement(corpus, norm):
    rows, docs, counts, _, sizes, stats = fitted(corpus)
    got = probs(nb.score(nb.fit_complement(stats, sizes, 0.4, norm), counts, docs, "bug_id"))

    def ll(x, tx, ty, c):
        s = tx[ty != c].sum(axis=0) + 0.4
        w = -np.log(s / s.sum())
        return x @ (w / np.abs(w).sum() if norm else w)

    assert got == pytest.approx(expected(rows, ll))


def test_all_trials_equal_single_fits(spark, corpus):
    """One pass over all trials gives what each model gives alone."""
    rows, docs, counts, train, sizes, stats = fitted(corpus)
    study = spark.createDataFrame([("s",)], "study string")
    stats = nb.term_stats(train, sizes, "y", moments=True)
    trials = materialise(se.random_trials(study, "study", 30))
    scores = se.trial_scores(trials, stats, sizes, counts, docs, "bug_id").collect()
    drawn = trials.collect()
    assert {t["classifier"] for t in drawn} == set(se.CLASSIFIERS)
    for t in drawn:
        prior = nb.Prior(given=(t["class_prior"], 1 - t["class_prior"]))
        if t["classifier"] == "MultinomialNB":
            model = nb.fit_multinomial(stats, sizes, t["alpha"], prior)
        elif t["classifier"] == "BernoulliNB":
            model = nb.fit_presence(stats, sizes, t["alpha"], prior)
        elif t["classifier"] == "GaussianNB":
            model = nb.fit_gaussian_terms(stats, sizes, t["var_smoothing"], prior)
        else:
            model = nb.fit_complement(stats, sizes, t["alpha"], bool(t["norm"]))
        want = probs(nb.score(model, counts, docs, "bug_id"))
        got = {r["bug_id"]: r["prob"] for r in scores if r["trial"] == t["trial"]}
        assert got == pytest.approx(want, abs=1e-9)


def test_groups_of_trials_change_nothing(spark, corpus, monkeypatch):
    _, docs, counts, train, sizes, _ = fitted(corpus)
    stats = nb.term_stats(train, sizes, "y", moments=True)
    trials = materialise(se.random_trials(spark.createDataFrame([("s",)], "study string"), "study", 7))
    rows = lambda: sorted((r["trial"], r["bug_id"], r["prob"]) for r in se.trial_scores(trials, stats, sizes, counts, docs, "bug_id").collect())
    whole = rows()
    monkeypatch.setattr(se, "GROUP_TRIALS", 3)
    assert [x[:2] for x in rows()] == [x[:2] for x in whole]
    assert [x[2] for x in rows()] == pytest.approx([x[2] for x in whole])


def test_presence_ignores_terms_of_all_texts(spark):
    rows = [(0, 0, "a", 2), (0, 0, "b", 1), (1, 1, "a", 1), (2, 1, "a", 4), (2, 1, "c", 9)]
    counts = spark.createDataFrame(rows, "bug_id long, y int, term string, n long")
    docs = counts.select("bug_id", "y").distinct()
    sizes = nb.class_sizes(docs, "y")
    got = probs(nb.score(nb.fit_presence(nb.term_stats(counts, sizes, "y"), sizes), counts, docs, "bug_id"))
    x = np.array([[0, 1, 0], [0, 0, 0], [0, 0, 1]])  # a, which every text has, b, c
    p = np.array([(x[:1].sum(0) + 1) / 3, (x[1:].sum(0) + 1) / 4])
    z = np.log(p) @ x.T + np.log(1 - p) @ (1 - x).T + np.log([[1 / 3], [2 / 3]])
    assert [got[i] for i in range(3)] == pytest.approx(list(1 / (1 + np.exp(z[0] - z[1]))))


@pytest.mark.parametrize("p", [1, 2, 3])
def test_knn_equals_brute_force_with_a_hot_cell(spark, p):
    """A third of the training rows are copies of one point; blocks are tiny."""
    rng = np.random.default_rng(p)
    train = [[float(v) for v in row] for row in rng.normal(size=(200, 6))] + [[0.25] * 6] * 100
    asked = [[float(v) for v in row] for row in rng.normal(size=(70, 6))] + [[0.25] * 6] * 30
    t = spark.createDataFrame([(i, v) for i, v in enumerate(train)], "id long, v array<double>")
    q = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(asked)], "id long, v array<double>")
    got = {}
    for r in knn.knn_join(q, t, "id", "v", k=4, p=p, n_pivots=9, block_rows=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["neighbour_id"], r["distance"])
    gap = knn.distances(np.array(asked), np.array(train), p)
    for i in range(len(asked)):
        want = sorted((gap[i, j], j) for j in range(len(train)))[:4]
        assert [got[1000 + i][n + 1][0] for n in range(4)] == [j for _, j in want]
        assert [got[1000 + i][n + 1][1] for n in range(4)] == pytest.approx([d for d, _ in want])


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(25, 4)) * 50
    return [[float(x) for x in centres[i % 25] + rng.normal(size=4)] for i in range(n)]


def test_knn_visits_few_blocks_and_copies_no_training_row(spark):
    t = spark.createDataFrame(list(enumerate(clustered(3000, 1))), "id long, v array<double>")
    q = spark.createDataFrame(list(enumerate(clustered(500, 2))), "id long, v array<double>")
    pivots = knn._pick_pivots(t, 55)
    celled = t.mapInArrow(knn._in_cells(pivots, 2), "id long, v array<double>, cell int, gap double")
    placed, blocks = knn._rings(celled, pivots, 2, 32)
    rows = placed.collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    assert int(blocks.parts.sum()) > 90
    first = q.mapInArrow(knn._first_visits(blocks, 4), "id long, v array<double>, unit int, part int, bound double")
    near = knn._nearest(knn._searched(first.drop("bound"), placed, 4, 2, (), 1 << 18), 4)
    kth = near.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("d"))
    bounded = first.join(kth, "id").select("id", "v", "unit", "part", F.least("bound", "d").alias("bound"))
    visits = bounded.mapInArrow(knn._further_visits(blocks), "id long, v array<double>, unit int, part int").count()
    assert visits < 500 * int(blocks.parts.sum()) * 0.15  # a twentieth would be all blocks of the own cluster


@pytest.mark.parametrize("visitor_rows", [7, 1 << 18])
def test_knn_carries_labels_through_crowded_blocks(spark, visitor_rows):
    train, asked = clustered(300, 3), clustered(90, 4)
    t = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(train)] + [(999, None, 1)], "id long, v array<double>, y int")
    q = spark.createDataFrame([*enumerate(asked), (888, None)], "id long, v array<double>")
    found = knn.knn_join(q, t, "id", "v", 3, block_rows=16, carried=["y"], visitor_rows=visitor_rows).collect()
    gap = knn.distances(np.array(asked), np.array(train), 2)
    want = [(i, int(j), int(j) % 3) for i in range(90) for j in np.argsort(gap[i], kind="stable")[:3]]
    assert sorted((r["query_id"], r["neighbour_id"], r["y"]) for r in found) == sorted(want)


def test_knn_copies_a_query_once_a_tile_where_nothing_is_ruled_out(spark, monkeypatch):
    """In many equal dimensions no cell is too far; a copy for each cell would grow faster than the pairs' bound."""
    rng = np.random.default_rng(8)
    t = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 32)).tolist())], "id long, v array<double>")
    q = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(50, 32)).tolist())], "id long, v array<double>")
    written = {}

    def noted(df, name="stage"):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(knn, "materialise", noted)
    assert knn.knn_join(q, t, "id", "v", k=3).count() == 150
    assert written["further_visits"].count() < 5 * 50  # 30 cells


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e4), (1e12, 0.0), (1e-25, 0.0)])
def test_tile_keeps_every_near_row(p, scale, shift):
    """Copies, near ties and far-off or tiny values; bounds that are exact, none, or missing."""
    rng = np.random.default_rng(p)
    rows = np.concatenate([rng.normal(size=(300, 20)), np.repeat(rng.normal(size=(3, 20)), 40, axis=0)]) * scale + shift
    asked = np.concatenate([rng.normal(size=(30, 20)) * scale + shift, rows[-2:]])
    gap = knn.distances(asked, rows, p)
    want = np.argsort(gap, axis=1, kind="stable")[:, :6]
    far = np.take_along_axis(gap, want, axis=1)[:, -1]
    tile = knn.Tile(rows, 6, p)
    assert len(tile.rows) == 300 + 3 * 6
    for bound in (far, np.full(len(asked), np.inf), np.full(len(asked), np.nan)):
        query, row, found = tile.nearest(asked, bound, 6)
        assert query.tolist() == np.repeat(np.arange(len(asked)), 6).tolist()
        assert row.reshape(-1, 6).tolist() == want.tolist()
        assert found.tolist() == gap[query, row].tolist()


def test_knn_with_fewer_rows_than_k(spark):
    t = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    got = knn.knn_join(t, t, "id", "v", k=5).collect()
    assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_zero_distance_takes_all_weight(spark):
    near = spark.createDataFrame([(9, 1, 0.0), (9, 2, 0.5), (8, 1, 1.0), (8, 2, 0.25)], "query_id long, neighbour_id long, distance double")
    train = spark.createDataFrame([(1, 1), (2, 0)], "id long, y int")
    got = {r["query_id"]: r["prob"] for r in knn.knn_predict(near, train, "id", "y", "distance").collect()}
    assert got == {9: 1.0, 8: pytest.approx(0.2)}


def test_minkowski_expression(spark):
    a, b = [1.0, -2.0, 0.5], [0.0, 1.0, 0.5]
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    got = spark.range(1).select(*[minkowski(lit(a), lit(b), p) for p in (1, 2, 3)]).first()
    want = [knn.distances(np.array([a]), np.array([b]), p)[0, 0] for p in (1, 2, 3)]
    assert list(got) == pytest.approx(want)


def test_constant_dimension_scales_to_zero(spark):
    train = spark.createDataFrame([([3.0, 1.0],), ([3.0, 2.0],)], "v array<double>")
    val = spark.createDataFrame([([3.0, 4.0],), ([5.0, 1.5],)], "v array<double>")
    got = [r["scaled"] for r in ft.scale_vectors(val, "v", train).collect()]
    assert got == [[0.0, 3.0], [0.0, 0.5]]


def test_failing_scorer(spark):
    """One bad prompt fails alone; its batch is scored."""

    def make():
        def score(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("no answer")
            return ["severe" if "crash" in p else "0" for p in prompts]

        return score

    df = spark.createDataFrame([(1, "crash"), (2, "boom"), (3, "typo")], "id long, p string").coalesce(1)
    got = {r["id"]: r["severity_pred"] for r in cl.score_prompts(df, "p", make).collect()}
    assert got == {1: 1, 2: -2, 3: 0}


def test_scorer_is_loaded_once_and_tried_again(spark, tmp_path):
    """Short answers and failures cost a try, null prompts are not sent, batches stay within their bound."""
    log = tmp_path / "calls"

    def make():
        with log.open("a") as f:
            f.write("load\n")
        state = {"calls": 0}

        def score(prompts):
            state["calls"] += 1
            with log.open("a") as f:
                f.write(f"{len(prompts)}\n")
            if state["calls"] == 1:
                raise TimeoutError
            if state["calls"] == 2:
                return []
            if "bad" in prompts:
                raise ValueError
            return ["1"] * len(prompts)

        return score

    rows = [(1, "a"), (2, "b"), (3, None), (4, "bad"), (5, "c"), (6, "d")]
    df = spark.createDataFrame(rows, "id long, p string").coalesce(1)
    got = {r["id"]: (r["severity_pred"], r["n_tries"]) for r in cl.score_prompts(df, "p", make, 3, 2).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (-2, 0), 4: (-2, 6), 5: (1, 4), 6: (1, 1)}
    calls = log.read_text().split()
    assert calls == ["load", *["2"] * 6, *["1"] * 5]
    with pytest.raises(ValueError):
        cl.score_prompts(df, "p", make, tries=0)
    assert cl.score_prompts(df.limit(0), "p", make).count() == 0


def test_bernoulli_query_counts_a_term_as_present_above_a_tenth(spark, tmp_path):
    """'often' stands in many texts but once beside 30 times in one: scaled, it is absent from the others."""
    from triagedeck.plans.models import nb_bernoulli

    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=4) + ["often"] * (30 if i == 7 else i % 2)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = nb_bernoulli(spark, str(tmp_path)).collect()
    rows = [(r["bug_id"], r["binary_severity"], r["split"], texts[r["bug_id"]]) for r in found]
    x, train, y = dense(rows)
    x = x > 0.1
    z = []
    for c, prior in ((0, 0.3), (1, 0.7)):
        own = x[train & (y == c)]
        p = (own.sum(axis=0) + 0.5) / (len(own) + 1)
        z.append(x @ np.log(p) + (1 - x) @ np.log(1 - p) + math.log(prior))
    assert [r["prob"] for r in found] == pytest.approx(list(1 / (1 + np.exp(z[0] - z[1]))), abs=2e-6)
