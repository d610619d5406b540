"""Features, models and model selection."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import prompts as px
from ..functions import text as tx
from ..operators import classifiers as cl
from ..operators import features as ft
from ..operators import naive_bayes as nb
from ..operators import search as se
from ..operators.curves import auc
from ..operators.knn import knn_join, knn_trials
from ..operators.metrics import accuracy, f1_averages
from ..operators.ranks import shuffled_rank
from ..operators.splits import sample_ladder, stratified_kfold, stratified_split
from ..session import materialise
from .base import (
    BOW,
    DOCS,
    SPLIT,
    SVECTORS,
    VECTORS,
    docs,
    query,
    r6,
    sql,
    table,
    texts,
    vectors,
)
from .text import TEMPLATE_SQL, TEMPLATE_TOKENS, tokens_sql

KEY, LABEL = "bug_id", "binary_severity"


KEEP = (LABEL, "split")


def _split_docs(spark, sf):
    """(key, label, split): only ids take part in the ranking."""
    return stratified_split(docs(spark, sf).select(KEY, LABEL), KEY, LABEL)


def _counts(spark, sf):
    return ft.term_counts(docs(spark, sf), KEY, "description")


def _train(df):
    return df.filter("split = 'tr'")


def _n(df):
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _prepared(spark, sf):
    """The split texts, and their term counts with label and split.

    Both are written once. The texts meet their split in one shuffle by key; the counts
    are grouped within it.
    """
    split = materialise(_split_docs(spark, sf), "split")
    described = texts(spark, sf).select(
        F.col("doc_id").alias(KEY), F.col("text").alias("description")
    )
    counts = ft.term_counts(described.join(split, KEY), KEY, "description", KEEP)
    return split, materialise(counts, "counts")


TRAIN_BOW = """trainbow AS (SELECT b.* FROM bow b JOIN sdocs s ON b.bug_id = s.bug_id WHERE s.split = 'tr')"""
RANGES = """rng AS (SELECT term, CASE WHEN count(*) < (SELECT count(*) FROM sdocs WHERE split = 'tr') THEN 0 ELSE min(n) END AS lo,
  max(n) AS hi FROM trainbow GROUP BY term),
scaled AS (SELECT b.bug_id, b.term, CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (n - lo) / (hi - lo)::DOUBLE END AS x,
  CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE -lo / (hi - lo)::DOUBLE END AS absent FROM bow b JOIN rng r ON b.term = r.term),
labelled AS (SELECT s.*, d.binary_severity AS y FROM scaled s JOIN sdocs d ON s.bug_id = d.bug_id WHERE d.split = 'tr'),
sizes AS (SELECT count_if(binary_severity = 0)::DOUBLE AS n0, count_if(binary_severity = 1)::DOUBLE AS n1 FROM sdocs WHERE split = 'tr'),
absents AS (SELECT DISTINCT term, absent FROM scaled)"""
TEXT = (DOCS, SPLIT, BOW, TRAIN_BOW, RANGES)

# --- features ---


@query("bow_counts", sql(DOCS, BOW, body="SELECT bug_id, term, n FROM bow"))
def bow_counts(spark, sf):
    return _counts(spark, sf)


@query("bow_vocabulary", sql(DOCS, SPLIT, BOW, TRAIN_BOW, body="""
SELECT count(DISTINCT term) AS n_terms, min(term) AS first_term FROM trainbow"""))
def bow_vocabulary(spark, sf):
    split = _train(_split_docs(spark, sf)).select(KEY)
    return ft.vocabulary_size(_counts(spark, sf).join(split, KEY, "left_semi"))


@query("bow_binary", sql(DOCS, BOW, body="SELECT bug_id, term, 1::BIGINT AS n FROM bow"))
def bow_binary(spark, sf):
    return ft.binary_counts(_counts(spark, sf))


@query("tfidf", sql(DOCS, SPLIT, BOW, TRAIN_BOW, body="""
, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM sdocs WHERE split = 'tr')) / (1 + count(*))::DOUBLE) + 1 AS idf FROM trainbow GROUP BY term),
v AS (SELECT bug_id, b.term, n * idf AS v FROM bow b JOIN idf i ON b.term = i.term)
SELECT bug_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY bug_id)), 6) AS tfidf FROM v"""))
def tfidf(spark, sf):
    split, counts = _prepared(spark, sf)
    found = ft.tfidf(counts, _train(counts), _n(_train(split)), KEY)
    return found.withColumn("tfidf", r6("tfidf"))


@query("minmax_scale", sql(VECTORS, SVECTORS, body="""
, cells AS (SELECT vec_id, split, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM svec)),
mm AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM cells WHERE split = 'tr' GROUP BY dim)
SELECT vec_id, CAST(c.dim AS INT) AS dim, round(CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END, 6) AS value FROM cells c JOIN mm ON c.dim = mm.dim"""))
def minmax_scale(spark, sf):
    s = stratified_split(vectors(spark, sf), "vec_id", "y")
    scaled = ft.scale_vectors(s, "embedding", s.filter("split = 'tr'"))
    return scaled.select("vec_id", F.posexplode("scaled").alias("dim", "value")).withColumn(
        "value", r6("value")
    )


@query("extract_xy", sql(DOCS, body="SELECT description AS features, binary_severity AS label FROM docs"))
def extract_xy(spark, sf):
    return ft.extract_xy(docs(spark, sf), "description", LABEL)


def _steps_sql(weight: str) -> str:
    """Scaled term values in small steps, each of them held."""
    return sql(DOCS, SPLIT, f"""held AS MATERIALIZED (SELECT bug_id, split FROM sdocs),
terms AS (SELECT bug_id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs),
bow AS MATERIALIZED (SELECT bug_id, term, {weight} AS n FROM terms GROUP BY bug_id, term),
size AS MATERIALIZED (SELECT count(*) AS n_train FROM held WHERE split = 'tr'),
seen AS MATERIALIZED (SELECT term, count(*) AS df, min(n) AS low, max(n) AS hi FROM bow JOIN held USING (bug_id)
  WHERE split = 'tr' GROUP BY term),
rng AS MATERIALIZED (SELECT term, CASE WHEN df < n_train THEN 0 ELSE low END AS lo, hi FROM seen, size)""", body="""
SELECT bug_id, term, round(CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (n - lo) / (hi - lo)::DOUBLE END, 6) AS x
FROM bow JOIN rng USING (term)""")


@query("feature_steps", _steps_sql("count(*)"))
def feature_steps(spark, sf):
    """Counts, then min-max scaling fitted on the training texts."""
    split, counts = _prepared(spark, sf)
    ranges = ft.fit_term_range(_train(counts), _n(_train(split)))
    return ft.scale_terms(counts, ranges, KEY).select(KEY, "term", r6("x").alias("x"))


@query("feature_steps_binary", _steps_sql("1"))
def feature_steps_binary(spark, sf):
    split, counts = _prepared(spark, sf)
    counts = ft.binary_counts(counts)
    ranges = ft.fit_term_range(_train(counts), _n(_train(split)))
    return ft.scale_terms(counts, ranges, KEY).select(KEY, "term", r6("x").alias("x"))


SIZES = [50, 100, 200, -1]


@query("fit_transform_splits", sql(DOCS, SPLIT, BOW, body="""
, tr AS (SELECT bug_id, row_number() OVER (ORDER BY md5('ladder|' || bug_id)) AS rk FROM sdocs WHERE split = 'tr'),
va AS (SELECT bug_id, row_number() OVER (ORDER BY md5('ladder|' || bug_id)) AS rk FROM sdocs WHERE split = 'val'),
sz AS (SELECT unnest([50, 100, 200, -1]) AS n_samples),
ladder AS (SELECT n_samples, bug_id FROM tr, sz WHERE n_samples = -1 OR rk <= n_samples),
sets AS (SELECT n_samples, 'tr' AS "set", bug_id FROM ladder UNION ALL
  SELECT n_samples, 'val', bug_id FROM va, sz WHERE n_samples = -1 OR rk <= n_samples UNION ALL
  SELECT n_samples, 'all_val', bug_id FROM sdocs, sz WHERE split = 'val' UNION ALL
  SELECT n_samples, 'all_test', bug_id FROM sdocs, sz WHERE split = 'test'),
cnt AS (SELECT n_samples, count(*) AS n_train FROM ladder GROUP BY n_samples),
fit AS (SELECT l.n_samples, term, CASE WHEN count(*) < max(n_train) THEN 0 ELSE min(n) END AS lo, max(n) AS hi
  FROM bow b JOIN ladder l ON b.bug_id = l.bug_id JOIN cnt c ON c.n_samples = l.n_samples GROUP BY l.n_samples, term)
SELECT s.n_samples, s."set", count(DISTINCT s.bug_id) AS n_rows, count(DISTINCT b.term) AS n_terms,
  round(sum(CASE WHEN hi = lo THEN 0 ELSE (n - lo) / (hi - lo)::DOUBLE END), 4) AS total
FROM bow b JOIN sets s ON b.bug_id = s.bug_id JOIN fit f ON f.n_samples = s.n_samples AND f.term = b.term GROUP BY s.n_samples, s."set\""""))
def fit_transform_splits(spark, sf):
    split, counts = _prepared(spark, sf)
    ladder = sample_ladder(split.filter("split = 'tr'").select(KEY), KEY, SIZES, "ladder")
    val = sample_ladder(split.filter("split = 'val'").select(KEY), KEY, SIZES, "ladder")
    steps = F.explode(F.array(*[F.lit(s) for s in SIZES]))
    whole = lambda s, name: split.filter(F.col("split") == s).select(
        steps.alias("n_samples"), F.lit(name).alias("set"), KEY
    )
    part = lambda df, name: df.select("n_samples", F.lit(name).alias("set"), KEY)
    sets = (
        part(ladder, "tr")
        .union(part(val, "val"))
        .union(whole("val", "all_val"))
        .union(whole("test", "all_test"))
    )
    counts = counts.select(KEY, "term", "n")
    rows = materialise(ft.ladder_features(counts, ladder.select("n_samples", KEY), sets, KEY), "rows")
    # Two levels instead of distinct counts: texts first, then terms.
    by_text = rows.groupBy("n_samples", "set", KEY).agg(F.sum("x").alias("x"))
    texts = by_text.groupBy("n_samples", "set").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("x"), 4).alias("total")
    )
    terms = (
        rows.groupBy("n_samples", "set", "term")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("n_samples", "set")
        .agg(F.count(F.lit(1)).alias("n_terms"))
    )
    return texts.join(terms, ["n_samples", "set"]).select(
        "n_samples", "set", "n_rows", "n_terms", "total"
    )


# --- naive Bayes ---


def _score_sql(model: str, rows: str = "(x - absent)") -> tuple[str, ...]:
    return (
        model,
        f"""zs AS (SELECT s.bug_id, sum({rows} * w0) AS z0, sum({rows} * w1) AS z1 FROM scaled s JOIN w ON s.term = w.term GROUP BY s.bug_id),
scores AS (SELECT d.bug_id, d.binary_severity, d.split, coalesce(z0, 0) + b0 AS z0, coalesce(z1, 0) + b1 AS z1
  FROM sdocs d LEFT JOIN zs ON d.bug_id = zs.bug_id CROSS JOIN base)""",
    )


NB_BODY = """
SELECT bug_id, binary_severity, split, round(1 / (1 + exp(z0 - z1)), 6) AS prob, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM scores"""

MULTINOMIAL = """st AS (SELECT term, sum(CASE WHEN y = 0 THEN x ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN x ELSE 0 END) AS s1 FROM labelled GROUP BY term),
tot AS (SELECT sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM st),
w AS (SELECT term, ln(s0 + 1) - ln(t0 + v) AS w0, ln(s1 + 1) - ln(t1 + v) AS w1 FROM st, tot),
base AS (SELECT ln(n0 / (n0 + n1)) + (SELECT sum(absent * w0) FROM absents a JOIN w ON a.term = w.term) AS b0,
  ln(n1 / (n0 + n1)) + (SELECT sum(absent * w1) FROM absents a JOIN w ON a.term = w.term) AS b1 FROM sizes)"""


def _shown(scored):
    return scored.select(KEY, LABEL, "split", r6("prob").alias("prob"), "pred")


def _fitted(spark, sf, moments=False):
    """Split texts, counts, class sizes and training terms."""
    split, counts = _prepared(spark, sf)
    sizes = nb.class_sizes(_train(split), LABEL)
    return split, counts, sizes, nb.term_stats(_train(counts), sizes, LABEL, moments)


def _multinomial(spark, sf):
    split, counts, sizes, stats = _fitted(spark, sf)
    return nb.score(nb.fit_multinomial(stats, sizes), counts, split, KEY)


@query("nb_multinomial", sql(*TEXT, *_score_sql(MULTINOMIAL), body=NB_BODY))
def nb_multinomial(spark, sf):
    return _shown(_multinomial(spark, sf))


BERNOULLI = """st AS (SELECT term, count_if(y = 0 AND x > 0.1) AS s0, count_if(y = 1 AND x > 0.1) AS s1 FROM labelled GROUP BY term),
w AS (SELECT term, ln((s0 + 0.5) / (n0 + 1)) - ln((n0 - s0 + 0.5) / (n0 + 1)) AS w0, ln((s1 + 0.5) / (n1 + 1)) - ln((n1 - s1 + 0.5) / (n1 + 1)) AS w1,
  ln((n0 - s0 + 0.5) / (n0 + 1)) AS a0, ln((n1 - s1 + 0.5) / (n1 + 1)) AS a1 FROM st, sizes),
base AS (SELECT ln(0.3) + (SELECT sum(a0) FROM w) AS b0, ln(0.7) + (SELECT sum(a1) FROM w) AS b1 FROM sizes)"""


@query("nb_bernoulli", sql(*TEXT, *_score_sql(BERNOULLI, "(x > 0.1)::INT"), body=NB_BODY))
def nb_bernoulli(spark, sf):
    split, counts, sizes, stats = _fitted(spark, sf)
    model = nb.fit_bernoulli(
        _train(counts), stats, sizes, LABEL, 0.5, 0.1, nb.Prior(given=(0.3, 0.7))
    )
    return _shown(nb.score(model, counts, split, KEY))


MOMENTS = """st AS (SELECT term, max(absent) AS a, count(*) AS k, avg(x) AS m, var_pop(x) AS q,
  count(CASE WHEN y = 0 THEN 1 END) AS k0, coalesce(avg(CASE WHEN y = 0 THEN x END), 0) AS a0, coalesce(var_pop(CASE WHEN y = 0 THEN x END), 0) AS q0,
  count(CASE WHEN y = 1 THEN 1 END) AS k1, coalesce(avg(CASE WHEN y = 1 THEN x END), 0) AS a1, coalesce(var_pop(CASE WHEN y = 1 THEN x END), 0) AS q1
  FROM labelled GROUP BY term),
mv AS (SELECT term, a, (k0 * a0 + (n0 - k0) * a) / n0 AS m0, (k0 * q0 + k0 * (n0 - k0) / n0 * (a0 - a) ** 2) / n0 AS v0,
  (k1 * a1 + (n1 - k1) * a) / n1 AS m1, (k1 * q1 + k1 * (n1 - k1) / n1 * (a1 - a) ** 2) / n1 AS v1,
  (k * q + k * (n0 + n1 - k) / (n0 + n1) * (m - a) ** 2) / (n0 + n1) AS v FROM st, sizes)"""
GAUSS = """g AS (SELECT term, a, m0, m1, v0 + e AS v0, v1 + e AS v1 FROM mv, (SELECT 0.01::DOUBLE * max(v) AS e FROM mv)),
base AS (SELECT ln(n0 / (n0 + n1)) + (SELECT sum(-0.5 * (ln(6.283185307179586 * v0) + (a - m0) ** 2 / v0)) FROM g) AS b0,
  ln(n1 / (n0 + n1)) + (SELECT sum(-0.5 * (ln(6.283185307179586 * v1) + (a - m1) ** 2 / v1)) FROM g) AS b1 FROM sizes),
zs AS (SELECT s.bug_id, sum(-0.5 * ((x - m0) ** 2 / v0 - (a - m0) ** 2 / v0)) AS z0, sum(-0.5 * ((x - m1) ** 2 / v1 - (a - m1) ** 2 / v1)) AS z1
  FROM scaled s JOIN g ON s.term = g.term GROUP BY s.bug_id),
scores AS (SELECT d.bug_id, d.binary_severity, d.split, coalesce(z0, 0) + b0 AS z0, coalesce(z1, 0) + b1 AS z1
  FROM sdocs d LEFT JOIN zs ON d.bug_id = zs.bug_id CROSS JOIN base)"""


@query("nb_gaussian", sql(*TEXT, MOMENTS, GAUSS, body=NB_BODY))
def nb_gaussian(spark, sf):
    split, counts, sizes, stats = _fitted(spark, sf, moments=True)
    model = nb.fit_gaussian_terms(stats, sizes, 0.01)
    return _shown(nb.score(model, counts, split, KEY))


@query("nb_gaussian_vectors", sql(VECTORS, SVECTORS, body="""
, cells AS (SELECT vec_id, y, split, i, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM svec)),
st AS (SELECT i, avg(CASE WHEN y = 0 THEN v END) AS m0, var_pop(CASE WHEN y = 0 THEN v END) AS v0, avg(CASE WHEN y = 1 THEN v END) AS m1,
  var_pop(CASE WHEN y = 1 THEN v END) AS v1, var_pop(v) AS va FROM cells WHERE split = 'tr' GROUP BY i),
g AS (SELECT i, m0, m1, v0 + e AS v0, v1 + e AS v1 FROM st, (SELECT 1e-9::DOUBLE * max(va) AS e FROM st)),
n AS (SELECT count_if(y = 0)::DOUBLE AS n0, count_if(y = 1)::DOUBLE AS n1 FROM svec WHERE split = 'tr'),
z AS (SELECT vec_id, y, split, -0.5 * sum(ln(v0 * 6.283185307179586) + (v - m0) ** 2 / v0) + max(ln(n0 / (n0 + n1))) AS z0,
  -0.5 * sum(ln(v1 * 6.283185307179586) + (v - m1) ** 2 / v1) + max(ln(n1 / (n0 + n1))) AS z1 FROM cells c JOIN g ON c.i = g.i, n GROUP BY vec_id, y, split)
SELECT vec_id, y, split, round(1 / (1 + exp(z0 - z1)), 6) AS prob, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM z"""))
def nb_gaussian_vectors(spark, sf):
    s = stratified_split(vectors(spark, sf), "vec_id", "y")
    train = s.filter("split = 'tr'")
    model = nb.fit_gaussian(train, "y", "embedding")
    scored = nb.score_gaussian(model, nb.class_sizes(train, "y"), s, "embedding")
    return scored.select("vec_id", "y", "split", r6("prob").alias("prob"), "pred")


COMPLEMENT = """st AS (SELECT term, sum(CASE WHEN y = 0 THEN x ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN x ELSE 0 END) AS s1 FROM labelled GROUP BY term),
tot AS (SELECT sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM st),
raww AS (SELECT term, -ln((s1 + 0.5) / (t1 + 0.5 * v)) AS w0, -ln((s0 + 0.5) / (t0 + 0.5 * v)) AS w1 FROM st, tot),
w AS (SELECT term, w0 / (SELECT sum(abs(w0)) FROM raww) AS w0, w1 / (SELECT sum(abs(w1)) FROM raww) AS w1 FROM raww),
base AS (SELECT (SELECT sum(absent * w0) FROM absents a JOIN w ON a.term = w.term) AS b0,
  (SELECT sum(absent * w1) FROM absents a JOIN w ON a.term = w.term) AS b1)"""


@query("nb_complement", sql(*TEXT, *_score_sql(COMPLEMENT), body=NB_BODY))
def nb_complement(spark, sf):
    split, counts, sizes, stats = _fitted(spark, sf)
    return _shown(nb.score(nb.fit_complement(stats, sizes, 0.5, norm=True), counts, split, KEY))


# Equal texts get equal scores only up to rounding of their sums; nine digits
# make them tie, as they must in a rank statistic.
def _tied(scored):
    return scored.withColumn("prob", F.round("prob", 9))


def _auc_sql(src: str, group: str, name: str = "areas", where: str = "") -> str:
    return f"""{name}_c AS (SELECT {group}, s, count_if(binary_severity = 1) AS pos, count_if(binary_severity = 0) AS neg FROM
  (SELECT *, round(prob, 9) AS s FROM {src} {where}) GROUP BY {group}, s),
{name}_r AS (SELECT *, sum(pos) OVER (PARTITION BY {group} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM {name}_c),
{name} AS (SELECT {group}, (sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)))::DOUBLE AS auc FROM {name}_r GROUP BY {group})"""


PROBS = "probs AS (SELECT *, 1 / (1 + exp(z0 - z1)) AS prob, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM scores)"


@query("train_valid_test", sql(*TEXT, *_score_sql(MULTINOMIAL), PROBS, _auc_sql("probs", "split"), body="""
SELECT 'MultinomialNB' AS classifier, round((SELECT avg((binary_severity = pred)::INT) FROM probs WHERE split = 'tr'), 6) AS train_accuracy,
  round((SELECT auc FROM areas WHERE split = 'val'), 6) AS auc_val, round((SELECT auc FROM areas WHERE split = 'test'), 6) AS auc_test"""))
def train_valid_test(spark, sf):
    scored = materialise(_tied(_multinomial(spark, sf)), "scored")
    found = cl.train_valid_test(scored, LABEL, "MultinomialNB")
    return found.withColumns({c: r6(c) for c in ("train_accuracy", "auc_val", "auc_test")})


@query("cv_table", sql(DOCS, BOW, body="""
, folds AS (SELECT seed, bug_id, binary_severity AS y, (row_number() OVER (PARTITION BY seed, binary_severity ORDER BY md5(seed || '|' || bug_id)) - 1) % 5 AS fold
  FROM docs, (SELECT unnest([0, 1]) AS seed)),
rows AS (SELECT f.seed, f.fold, f.bug_id, f.y, b.term, b.n FROM bow b JOIN folds f ON b.bug_id = f.bug_id),
own AS (SELECT seed, fold, term, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS o0, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS o1 FROM rows GROUP BY ALL),
al AS (SELECT seed, term, sum(o0) AS a0, sum(o1) AS a1 FROM own GROUP BY ALL),
fs AS (SELECT seed, fold, sum(o0) AS fo0, sum(o1) AS fo1 FROM own GROUP BY ALL),
ss AS (SELECT seed, sum(a0) AS fa0, sum(a1) AS fa1, count(*) AS v FROM al GROUP BY ALL),
nd AS (SELECT seed, fold, count_if(y = 0) AS n0, count_if(y = 1) AS n1 FROM folds GROUP BY ALL),
ns AS (SELECT seed, sum(n0) AS s0, sum(n1) AS s1 FROM nd GROUP BY ALL),
z AS (SELECT r.seed, r.fold, r.bug_id, r.y AS binary_severity,
  sum(r.n * (ln(a0 - o0 + 1) - ln(fa0 - fo0 + v))) + max(ln((s0 - n0) / (s0 - n0 + s1 - n1)::DOUBLE)) AS z0,
  sum(r.n * (ln(a1 - o1 + 1) - ln(fa1 - fo1 + v))) + max(ln((s1 - n1) / (s0 - n0 + s1 - n1)::DOUBLE)) AS z1
  FROM rows r JOIN own ON own.seed = r.seed AND own.fold = r.fold AND own.term = r.term JOIN al ON al.seed = r.seed AND al.term = r.term
  JOIN fs ON fs.seed = r.seed AND fs.fold = r.fold JOIN ss ON ss.seed = r.seed JOIN nd ON nd.seed = r.seed AND nd.fold = r.fold JOIN ns ON ns.seed = r.seed
  GROUP BY r.seed, r.fold, r.bug_id, r.y),
probs AS (SELECT *, 1 / (1 + exp(z0 - z1)) AS prob, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM z),
""" + _auc_sql("probs", "seed, fold") + """
SELECT p.seed, CAST(p.fold AS INT) AS fold, count(*) AS n, round(avg((binary_severity = pred)::INT), 6) AS accuracy, round(max(auc), 6) AS auc
FROM probs p JOIN areas a ON a.seed = p.seed AND a.fold = p.fold GROUP BY p.seed, p.fold"""))
def cv_table(spark, sf):
    d = docs(spark, sf)
    folds = materialise(stratified_kfold(d.select(KEY, LABEL), KEY, LABEL, 5, [0, 1]), "folds")
    counts = materialise(_counts(spark, sf), "counts")
    scored = materialise(_tied(nb.cross_validate(counts, folds, KEY, LABEL)), "scored")
    right = accuracy(scored, LABEL, "pred", ["seed", "fold"])
    areas = auc(scored, LABEL, "prob", ["seed", "fold"])
    return right.join(areas, ["seed", "fold"]).select(
        "seed", "fold", "n", r6("accuracy").alias("accuracy"), r6("auc").alias("auc")
    )


CURVE_SQL = """rk AS (SELECT bug_id, binary_severity AS y, row_number() OVER (ORDER BY md5('curve|' || bug_id), bug_id) AS rk FROM sdocs WHERE split = 'tr'),
ladder AS (SELECT n_samples, bug_id, y FROM rk, (SELECT unnest([50, 100, 200, -1]) AS n_samples) WHERE n_samples = -1 OR rk <= n_samples),
ln_ AS (SELECT n_samples, count_if(y = 0)::DOUBLE AS n0, count_if(y = 1)::DOUBLE AS n1 FROM ladder GROUP BY n_samples),
ls AS (SELECT l.n_samples, term, count_if(y = 0) AS k0, count_if(y = 1) AS k1, sum(CASE WHEN y = 0 THEN n ELSE 0 END)::DOUBLE AS t0, sum(CASE WHEN y = 1 THEN n ELSE 0 END)::DOUBLE AS t1,
  sum(CASE WHEN y = 0 THEN n * n ELSE 0 END)::DOUBLE AS u0, sum(CASE WHEN y = 1 THEN n * n ELSE 0 END)::DOUBLE AS u1, min(n) AS mn, max(n) AS hi
  FROM bow b JOIN ladder l ON b.bug_id = l.bug_id GROUP BY l.n_samples, term),
lr AS (SELECT s.*, n0, n1, CASE WHEN k0 + k1 < n0 + n1 THEN 0 ELSE mn END AS lo FROM ls s JOIN ln_ n ON n.n_samples = s.n_samples),
lt AS (SELECT *, hi - lo AS span, CASE WHEN hi = lo THEN 0 ELSE -lo / (hi - lo)::DOUBLE END AS absent,
  CASE WHEN hi = lo THEN 0 ELSE (t0 - k0 * lo) / (hi - lo) END AS s0, CASE WHEN hi = lo THEN 0 ELSE (t1 - k1 * lo) / (hi - lo) END AS s1,
  CASE WHEN lo = 0 THEN k0 ELSE 0 END AS p0, CASE WHEN lo = 0 THEN k1 ELSE 0 END AS p1,
  CASE WHEN hi = lo THEN 0 ELSE (t0 / n0 - lo) / (hi - lo) END AS m0, CASE WHEN hi = lo THEN 0 ELSE (t1 / n1 - lo) / (hi - lo) END AS m1,
  CASE WHEN hi = lo THEN 0 ELSE (u0 / n0 - (t0 / n0) ** 2) / (hi - lo) ** 2 END AS v0, CASE WHEN hi = lo THEN 0 ELSE (u1 / n1 - (t1 / n1) ** 2) / (hi - lo) ** 2 END AS v1,
  CASE WHEN hi = lo THEN 0 ELSE ((u0 + u1) / (n0 + n1) - ((t0 + t1) / (n0 + n1)) ** 2) / (hi - lo) ** 2 END AS v FROM lr),
lz AS (SELECT n_samples, sum(s0) AS z0, sum(s1) AS z1, count(*) AS vn, max(v) * 0.01::DOUBLE AS e FROM lt GROUP BY n_samples),
lw AS (SELECT t.n_samples, term, lo, hi, absent, m0, m1, v0 + e AS v0, v1 + e AS v1, n0, n1, p0, p1, ln((s1 + 1) / (z1 + vn)) - ln((s0 + 1) / (z0 + vn)) AS wm,
  ln(p1 + 1) - ln(n1 - p1 + 1) - ln(p0 + 1) + ln(n0 - p0 + 1) AS wb FROM lt t JOIN lz z ON z.n_samples = t.n_samples),
lb AS (SELECT n_samples, sum(absent * wm) AS bm, sum(ln((n1 - p1 + 1) / (n1 + 2)) - ln((n0 - p0 + 1) / (n0 + 2))) AS bb,
  sum(-0.5 * ((absent - m1) ** 2 / v1 - (absent - m0) ** 2 / v0) - 0.5 * (ln(v1) - ln(v0))) AS bg, ln(max(n1)) - ln(max(n0)) AS prior FROM lw GROUP BY n_samples),
lx AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (n - lo) / (hi - lo)::DOUBLE END AS x FROM bow b JOIN lw w ON w.term = b.term),
lp AS (SELECT n_samples, bug_id, sum((x - absent) * wm) AS zm, sum(CASE WHEN lo = 0 THEN wb ELSE 0 END) AS zb,
  sum(-0.5 * ((x - m1) ** 2 / v1 - (x - m0) ** 2 / v0) + 0.5 * ((absent - m1) ** 2 / v1 - (absent - m0) ** 2 / v0)) AS zg FROM lx GROUP BY ALL),
lm AS (SELECT b.n_samples, d.bug_id, d.binary_severity, d.split, coalesce(zm, 0) + bm + prior AS zm, coalesce(zb, 0) + bb + prior AS zb, coalesce(zg, 0) + bg + prior AS zg
  FROM sdocs d JOIN lb b ON d.split <> 'tr' LEFT JOIN lp p ON p.bug_id = d.bug_id AND p.n_samples = b.n_samples),
probs AS (SELECT n_samples, bug_id, binary_severity, split, c.name AS classifier, 1 / (1 + exp(-CASE c.name WHEN 'MultinomialNB' THEN zm WHEN 'BernoulliNB' THEN zb ELSE zg END)) AS prob
  FROM lm, (SELECT unnest(['MultinomialNB', 'BernoulliNB', 'GaussianNB']) AS name) c)"""


@query("learning_curve", sql(DOCS, SPLIT, BOW, CURVE_SQL, _auc_sql("probs", "classifier, n_samples, split"), body="""
SELECT classifier, n_samples, split, round(auc, 5) AS auc FROM areas"""))
def learning_curve(spark, sf):
    """AUC on validation and test by sample size: nested samples of the training texts, all fitted in one scan."""
    split, counts = _prepared(spark, sf)
    ranked = shuffled_rank(_train(split).select(KEY, LABEL), KEY, "curve")
    step = F.coalesce(*[F.when((F.col("rank") <= n) | F.lit(n == -1), i) for i, n in enumerate(SIZES)])
    ladder = materialise(ranked.select(KEY, LABEL, step.alias("step")), "ladder")
    later = F.col("split") != "tr"
    scores = se.ladder_fits(_train(counts).drop(LABEL), ladder, counts.filter(later), split.filter(later), KEY, LABEL, len(SIZES))
    areas = auc(_tied(scores), LABEL, "prob", ["classifier", "step", "split"])
    size = F.element_at(F.array(*[F.lit(n) for n in SIZES]), F.col("step") + 1)
    wide = areas.groupBy("classifier", size.alias("n_samples")).agg(
        *[F.max(F.when(F.col("split") == s, F.col("auc"))).alias(f"auc_{s}") for s in ("val", "test")]
    )
    return se.learning_curve(wide).withColumn("auc", F.round("auc", 5))


# --- trials ---

N_TRIALS = 50


def _u(name: str, study: str = "study", trial: str = "trial") -> str:
    return f"('0x' || substr(md5('0|{name}|' || {study} || '|' || {trial}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def trials_sql(studies: str) -> str:
    return f"""trials AS (SELECT study, trial, ['BernoulliNB', 'MultinomialNB', 'GaussianNB', 'ComplementNB'][(floor({_u('classifier')} * 4) + 1)::INT] AS classifier,
  exp(ln(1e-10::DOUBLE) + {_u('alpha')} * (ln(1.0::DOUBLE) - ln(1e-10::DOUBLE))) AS alpha, CASE WHEN {_u('fit_prior')} < 0.5 THEN 1 ELSE 0 END AS fit_prior,
  {_u('class_prior')} AS class_prior, {_u('binarize')} AS binarize, CASE WHEN {_u('norm')} >= 0.5 THEN 1 ELSE 0 END AS norm,
  exp(ln(1e-14::DOUBLE) + {_u('var_smoothing')} * (ln(1.0::DOUBLE) - ln(1e-14::DOUBLE))) AS var_smoothing
  FROM (SELECT study, unnest(range(0, {N_TRIALS}))::INT AS trial FROM ({studies})))"""


@query("random_trials", sql(trials_sql("SELECT DISTINCT lang AS study FROM documents"), body="""
SELECT study, trial, classifier, round(log10(alpha), 6) AS log_alpha, fit_prior, round(class_prior, 6) AS class_prior, round(binarize, 6) AS binarize, norm,
  round(log10(var_smoothing), 6) AS log_var_smoothing FROM trials"""))
def random_trials(spark, sf):
    studies = table(spark, sf, "documents").select(F.col("lang").alias("study")).distinct()
    t = se.random_trials(studies, "study", N_TRIALS)
    return t.select(
        "study",
        "trial",
        "classifier",
        r6(F.log10("alpha")).alias("log_alpha"),
        "fit_prior",
        r6("class_prior").alias("class_prior"),
        r6("binarize").alias("binarize"),
        "norm",
        r6(F.log10("var_smoothing")).alias("log_var_smoothing"),
    )


def _trials(spark, sf):
    study = table(spark, sf, "labels").select(F.lit("documents").alias("study")).distinct()
    return se.random_trials(study, "study", N_TRIALS)


def _trial_scores(spark, sf, fitted, trials, parts):
    split, counts, sizes, stats = fitted
    wanted = F.col("split").isin(*parts)
    return _tied(se.trial_scores(trials, stats, sizes, counts.filter(wanted), split.filter(wanted), KEY))


def search_sql(parts: str) -> str:
    """Scores of every trial for the texts of the named splits."""
    return f"""stt AS (SELECT trial, l.term, max(absent) AS absent, max(r.lo) AS lo, sum(CASE WHEN y = 0 THEN x ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN x ELSE 0 END) AS s1,
  CASE WHEN max(r.lo) = 0 THEN count_if(y = 0) ELSE 0 END AS c0, CASE WHEN max(r.lo) = 0 THEN count_if(y = 1) ELSE 0 END AS c1
  FROM labelled l JOIN rng r ON r.term = l.term, (SELECT trial FROM trials WHERE classifier <> 'GaussianNB') GROUP BY trial, l.term),
tott AS (SELECT trial, sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM stt GROUP BY trial),
wt AS (SELECT t.trial, t.classifier, t.norm, term, absent, lo,
  CASE t.classifier WHEN 'BernoulliNB' THEN ln(c0 + alpha) - ln(n0 - c0 + alpha) WHEN 'ComplementNB' THEN -ln((s1 + alpha) / (t1 + alpha * v)) ELSE ln((s0 + alpha) / (t0 + alpha * v)) END AS w0,
  CASE t.classifier WHEN 'BernoulliNB' THEN ln(c1 + alpha) - ln(n1 - c1 + alpha) WHEN 'ComplementNB' THEN -ln((s0 + alpha) / (t0 + alpha * v)) ELSE ln((s1 + alpha) / (t1 + alpha * v)) END AS w1,
  ln((n0 - c0 + alpha) / (n0 + 2 * alpha)) AS l0, ln((n1 - c1 + alpha) / (n1 + 2 * alpha)) AS l1
  FROM stt s JOIN tott o ON s.trial = o.trial JOIN trials t ON t.trial = s.trial, sizes),
gt AS (SELECT trial, term, a, m0, m1, v0 + e AS v0, v1 + e AS v1 FROM mv, (SELECT trial, var_smoothing * (SELECT max(v) FROM mv) AS e FROM trials WHERE classifier = 'GaussianNB')),
kt AS (SELECT trial, sum(CASE WHEN classifier = 'BernoulliNB' THEN l0 ELSE absent * w0 END) AS k0, sum(CASE WHEN classifier = 'BernoulliNB' THEN l1 ELSE absent * w1 END) AS k1,
  sum(abs(w0)) AS a0, sum(abs(w1)) AS a1 FROM wt GROUP BY trial
  UNION ALL SELECT trial, 0, sum(-0.5 * (ln(v1) - ln(v0) + (a - m1) ** 2 / v1 - (a - m0) ** 2 / v0)), 1, 1 FROM gt GROUP BY trial),
zt AS (SELECT w.trial, s.bug_id, sum(w0 * CASE WHEN classifier = 'BernoulliNB' THEN (lo = 0)::INT ELSE x - s.absent END) AS z0,
  sum(w1 * CASE WHEN classifier = 'BernoulliNB' THEN (lo = 0)::INT ELSE x - s.absent END) AS z1
  FROM scaled s JOIN wt w ON s.term = w.term JOIN sdocs d ON d.bug_id = s.bug_id AND d.split IN ({parts}) GROUP BY w.trial, s.bug_id
  UNION ALL SELECT g.trial, s.bug_id, 0, sum(-0.5 * ((x - m1) ** 2 / v1 - (x - m0) ** 2 / v0 - ((a - m1) ** 2 / v1 - (a - m0) ** 2 / v0)))
  FROM scaled s JOIN gt g ON s.term = g.term JOIN sdocs d ON d.bug_id = s.bug_id AND d.split IN ({parts}) GROUP BY g.trial, s.bug_id),
mt AS (SELECT t.trial, d.bug_id, d.binary_severity, d.split, CASE WHEN t.classifier = 'ComplementNB' AND t.norm = 1 THEN (coalesce(z1, 0) + k1) / a1 - (coalesce(z0, 0) + k0) / a0
  ELSE coalesce(z1, 0) - coalesce(z0, 0) + k1 - k0 + CASE WHEN t.classifier = 'ComplementNB' THEN 0 ELSE ln(1 - class_prior) - ln(class_prior) END END AS margin
  FROM trials t JOIN (SELECT * FROM sdocs WHERE split IN ({parts})) d ON true LEFT JOIN zt ON zt.trial = t.trial AND zt.bug_id = d.bug_id JOIN kt ON kt.trial = t.trial),
probs AS (SELECT trial, bug_id, binary_severity, split, 1 / (1 + exp(-margin)) AS prob FROM mt)"""


SEARCH = search_sql("'val'")
ONE_STUDY = trials_sql("SELECT DISTINCT 'documents' AS study FROM labels")


@query("search_trials", sql(*TEXT, MOMENTS, ONE_STUDY, SEARCH, _auc_sql("probs", "trial"), body="""
SELECT a.trial, t.classifier, round(auc, 5) AS value FROM areas a JOIN trials t ON t.trial = a.trial"""))
def search_trials(spark, sf):
    trials, values, _ = _tried(spark, sf)
    return values.join(trials, "trial").select("trial", "classifier", "value")


def _tried(spark, sf):
    """The drawn trials, their validation AUC and what was fitted."""
    fitted = _fitted(spark, sf, moments=True)
    trials = materialise(_trials(spark, sf), "drawn")
    values = se.evaluate_trials(_trial_scores(spark, sf, fitted, trials, ["val"]), LABEL)
    return trials, values.withColumn("value", F.round("value", 5)), fitted


@query("search_best", sql(*TEXT, MOMENTS, ONE_STUDY, SEARCH, _auc_sql("probs", "trial"), body="""
SELECT study, trial, classifier, value FROM (SELECT t.study, t.trial, t.classifier, round(auc, 5) AS value, row_number() OVER (PARTITION BY study ORDER BY round(auc, 5) DESC, t.trial) AS rn
FROM areas a JOIN trials t ON t.trial = a.trial) WHERE rn = 1"""))
def search_best(spark, sf):
    trials, values, _ = _tried(spark, sf)
    return se.best_trial(trials, values, "study").select("study", "trial", "classifier", "value")


@query("reproduce_best", sql(*TEXT, MOMENTS, ONE_STUDY, search_sql("'val', 'test'"), _auc_sql("probs", "trial, split"), body="""
, best AS (SELECT trial FROM (SELECT trial, row_number() OVER (ORDER BY round(auc, 5) DESC, trial) AS rn FROM areas WHERE split = 'val') WHERE rn = 1)
SELECT t.study, t.trial, t.classifier, a.split, round(auc, 5) AS auc FROM best b JOIN areas a ON a.trial = b.trial JOIN trials t ON t.trial = b.trial"""))
def reproduce_best(spark, sf):
    """The best validation trial alone, scored again on the full validation and test sets."""
    trials, values, fitted = _tried(spark, sf)
    best = materialise(se.best_trial(trials, values, "study"), "best")
    scores = _trial_scores(spark, sf, fitted, best.select(*trials.columns), ["val", "test"])
    areas = auc(scores.join(best.select("study", "trial", "classifier"), "trial"), LABEL, "prob", ["study", "trial", "classifier", "split"])
    return areas.withColumn("auc", F.round("auc", 5))


MODEL_TRIALS = f"""mtrials AS (SELECT study, trial, exp(ln(1e-5::DOUBLE) + {_u('svm_c')} * (ln(1e5::DOUBLE) - ln(1e-5::DOUBLE))) AS svm_c,
  ['none', 'balanced'][(floor({_u('class_weight')} * 2) + 1)::INT] AS class_weight, [1, 5, 7][(floor({_u('k')} * 3) + 1)::INT] AS k,
  ['uniform', 'distance'][(floor({_u('weights')} * 2) + 1)::INT] AS weights, [1, 2, 3][(floor({_u('p')} * 3) + 1)::INT] AS p,
  list_transform([1, 2, 3, 4][1:([1, 2, 3, 4][(floor({_u('layers')} * 4) + 1)::INT])], lambda i: (floor(('0x' || substr(md5('0|units_' || i || '|' || study || '|' || trial), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 125) + 4)::INT) AS mlp_units,
  [2, 16, 32, 64][(floor({_u('batch')} * 4) + 1)::INT] AS batch_size, exp(ln(1e-5::DOUBLE) + {_u('rate')} * (ln(1e-1::DOUBLE) - ln(1e-5::DOUBLE))) AS learning_rate
  FROM (SELECT study, unnest(range(0, {N_TRIALS}))::INT AS trial FROM (SELECT DISTINCT lang AS study FROM documents)))"""


@query("random_model_trials", sql(MODEL_TRIALS, body="""
SELECT study, trial, round(log10(svm_c), 6) AS log_c, class_weight, k, weights, p, array_to_string(mlp_units, ',') AS mlp_units, batch_size,
  round(log10(learning_rate), 6) AS log_rate FROM mtrials"""))
def random_model_trials(spark, sf):
    studies = table(spark, sf, "documents").select(F.col("lang").alias("study")).distinct()
    t = se.random_model_trials(studies, "study", N_TRIALS)
    return t.select(
        "study",
        "trial",
        r6(F.log10("svm_c")).alias("log_c"),
        "class_weight",
        "k",
        "weights",
        "p",
        F.array_join(F.col("mlp_units").cast("array<string>"), ",").alias("mlp_units"),
        "batch_size",
        r6(F.log10("learning_rate")).alias("log_rate"),
    )


def _near_sql(p: int) -> str:
    gap = {
        1: "list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))",
        2: "sqrt(list_sum(list_transform(range(1, 65), lambda i: power(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE, 2))))",
        3: "power(list_sum(list_transform(range(1, 65), lambda i: power(abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE), 3))), 1.0 / 3)",
    }[p]
    return f"""SELECT {p} AS p, q.vec_id AS query_id, q.y AS binary_severity, t.vec_id AS neighbour_id, t.y AS ty, {gap} AS distance
  FROM svec q, svec t WHERE q.split = 'val' AND t.split = 'tr'"""


KNN_SEARCH = f"""pairs AS ({" UNION ALL ".join(_near_sql(p) for p in (1, 2, 3))}),
near AS (SELECT *, row_number() OVER (PARTITION BY p, query_id ORDER BY distance, neighbour_id) AS rank FROM pairs QUALIFY rank <= 7),
probs AS (SELECT p, ks.k, ws.weights, query_id, binary_severity, CASE ws.weights WHEN 'uniform' THEN avg(ty) ELSE sum(ty / distance) / sum(1 / distance) END AS prob
  FROM near, (SELECT unnest([1, 5, 7]) AS k) ks, (SELECT unnest(['uniform', 'distance']) AS weights) ws WHERE rank <= ks.k GROUP BY p, ks.k, ws.weights, query_id, binary_severity)"""


@query("search_knn", sql(VECTORS, SVECTORS, KNN_SEARCH, _auc_sql("probs", "p, k, weights"), body="SELECT p, k, weights, round(auc, 5) AS value FROM areas"))
def search_knn(spark, sf):
    """Every neighbour setting on the validation vectors: one neighbour join per power."""
    s = materialise(stratified_split(vectors(spark, sf), "vec_id", "y"), "vectors")
    train, val = s.filter("split = 'tr'"), s.filter("split = 'val'")
    tried = None
    for p in se.POWERS:
        near = knn_join(val, train, "vec_id", "embedding", max(se.NEIGHBOURS), p, carried=["y"])
        part = knn_trials(near, train, "vec_id", "y", se.NEIGHBOURS).withColumn("p", F.lit(p))
        tried = part if tried is None else tried.union(part)
    truth = val.select(F.col("vec_id").alias("query_id"), "y")
    scored = _tied(tried.join(truth, "query_id"))
    return auc(scored, "y", "prob", ["p", "k", "weights"]).select(
        "p", "k", "weights", F.round("auc", 5).alias("value")
    )


def _vector_study(spark, sf, n_trials):
    study = table(spark, sf, "embeddings").select(F.lit("vectors").alias("study")).distinct()
    return materialise(se.random_model_trials(study, "study", n_trials), "drawn")


@query("search_mlp")
def search_mlp(spark, sf):
    """Drawn networks on the scaled vectors, by support-weighted F1 of validation."""
    s = stratified_split(vectors(spark, sf), "vec_id", "y")
    ft.guard_vectors(s, "embedding")
    rows = ft.scale_vectors(s, "embedding", s.filter("split = 'tr'")).withColumn(
        "features", array_to_vector("scaled")
    )
    rows = materialise(rows.drop("embedding", "scaled"), "vectors")
    train, val = rows.filter("split = 'tr'"), rows.filter("split = 'val'")

    def evaluate(t):
        model = cl.fit_mlp(train, "y", [64, *t["mlp_units"], 2], 20, t["learning_rate"])
        pred = model.transform(val).withColumn("pred", F.col("prediction").cast("int"))
        return f1_averages(pred, "y", "pred").first()["f1_weighted"]

    trials = _vector_study(spark, sf, 3)
    return trials.join(se.fit_trials(trials, evaluate, spark), "trial").select(
        "trial", F.array_join(F.col("mlp_units").cast("array<string>"), ",").alias("mlp_units"), r6("value").alias("value")
    )


# --- spark.ml models ---


def _quality(scored, classifier):
    """AUC and accuracy per split."""
    right = accuracy(scored, "y", "pred", ["split"])
    areas = auc(scored, "y", "prob", ["split"])
    return right.join(areas, "split").select(
        F.lit(classifier).alias("classifier"), "split", "n", r6("accuracy").alias("accuracy"), r6("auc").alias("auc")
    )


@query("mlp_embeddings")
def mlp_embeddings(spark, sf):
    s = stratified_split(vectors(spark, sf), "vec_id", "y")
    train = ft.guard_vectors(s, "embedding").filter("split = 'tr'")
    rows = ft.scale_vectors(s, "embedding", train).withColumn("features", array_to_vector("scaled"))
    rows = materialise(rows.drop("embedding", "scaled"), "vectors")
    model = cl.fit_mlp(rows.filter("split = 'tr'"), "y", [64, 16, 2], max_iter=60)
    scored = model.transform(rows).select(
        "vec_id",
        "y",
        "split",
        F.element_at(vector_to_array("probability"), 2).alias("prob"),
        F.col("prediction").cast("int").alias("pred"),
    )
    return _quality(scored, "MLP")


def rule_scorer():
    """Offline stand-in of a batch model, by the words between the template's marks of a prompt.

    It fails on every prompt with an exclamation mark, and on the first call after each such failure, as
    a model does that has run out of memory; so whole batches fail, and prompts beside a bad one need a second try.
    """
    hurt = [True]

    def score(prompts):
        if hurt[0]:
            hurt[0] = False
            raise RuntimeError("not ready")
        if any(" ! " in p for p in prompts):
            hurt[0] = True
            raise RuntimeError("no answer")
        words = [p.split(" ") for p in prompts]
        return [("SEVERE", "not severe", "0 or 1", "0", "1")[len(w[4]) % 5] for w in words]

    return score


PROMPT_BUDGET = 50


@query("score_prompts", f"""
WITH t AS (SELECT doc_id, list_prepend('<s>', {tokens_sql('text')}) AS d,
  {TEMPLATE_SQL} AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN list_concat(d[1:1], ['!'], d[2:]) ELSE d END AS d, t FROM t),
p AS (SELECT doc_id, list_concat(list_concat(t[2:5], d[2:{PROMPT_BUDGET - len(TEMPLATE_TOKENS) + 1}]), t[6:10]) AS p FROM b),
a AS (SELECT doc_id, array_to_string(p, ' ') AS prompt, CASE WHEN contains(array_to_string(p, ' '), ' ! ') THEN NULL
  ELSE ['SEVERE', 'not severe', '0 or 1', '0', '1'][length(p[5]) % 5 + 1] END AS answer FROM p)
SELECT doc_id, prompt, answer, CAST(CASE WHEN answer IS NULL THEN -2 WHEN answer IN ('not severe', '0') THEN 0
  WHEN answer IN ('SEVERE', '1') THEN 1 ELSE -1 END AS INTEGER) AS severity_pred FROM a""")
def score_prompts(spark, sf):
    """Texts to prompts within the token budget, through the scorer, to labels: all four codes occur."""
    tokens = tx.tokens(F.col("text"))
    bad = F.array(F.when(F.col("doc_id") % 9 == 4, "!"))
    described = F.concat(F.array(F.lit("<s>")), F.array_compact(bad), tokens)
    template = F.array(*[F.lit(t) for t in TEMPLATE_TOKENS])
    prompt = F.array_join(px.splice(template, F.lit(5), described, PROMPT_BUDGET), " ")
    built = texts(spark, sf).select("doc_id", prompt.alias("prompt"))
    return cl.score_prompts(built, "prompt", rule_scorer, tries=3).drop("n_tries")
