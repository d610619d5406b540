"""Random-search trials, one-pass evaluation of all trials, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .curves import auc
from .dedup import best_per_group
from .naive_bayes import one_row, scaled
from .ranks import hash_order, hash_uniform

# The searched classifiers and the ranges of their parameters.
CLASSIFIERS = ("BernoulliNB", "MultinomialNB", "GaussianNB", "ComplementNB")
ALPHA = (1e-10, 1.0)
VAR_SMOOTHING = (1e-14, 1.0)
SVM_C = (1e-5, 1e5)
CLASS_WEIGHTS = ("none", "balanced")
NEIGHBOURS = (1, 5, 7)
WEIGHTS = ("uniform", "distance")
POWERS = (1, 2, 3)
MLP_LAYERS = (1, 2, 3, 4)
MLP_UNITS = (4, 128)
MLP_BATCH = (2, 16, 32, 64)
MLP_RATE = (1e-5, 1e-1)
GROUP_TRIALS = 100  # trials that are columns of one plan


def draw(seed: int | str, name: str, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) that depends on the seed, the parameter and the trial."""
    return hash_uniform(hash_order(seed, F.lit(name), *keys))


def log_uniform(u: Column, lo: float, hi: float) -> Column:
    return F.exp(F.log(F.lit(lo)) + u * (F.log(F.lit(hi)) - F.log(F.lit(lo))))


def pick(u: Column, values: Sequence) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (F.floor(u * len(values)) + 1).cast("int"))


def random_trials(studies: DataFrame, study: str, n_trials: int, seed: int = 0) -> DataFrame:
    """``n_trials`` drawn parameter sets for every study of a table."""
    trials = studies.select(study, F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial"))

    def u(name: str) -> Column:
        return draw(seed, name, study, "trial")

    return trials.select(
        study,
        "trial",
        pick(u("classifier"), CLASSIFIERS).alias("classifier"),
        log_uniform(u("alpha"), *ALPHA).alias("alpha"),
        (u("fit_prior") < 0.5).cast("int").alias("fit_prior"),
        u("class_prior").alias("class_prior"),
        u("binarize").alias("binarize"),
        (u("norm") >= 0.5).cast("int").alias("norm"),
        log_uniform(u("var_smoothing"), *VAR_SMOOTHING).alias("var_smoothing"),
    )


def random_model_trials(studies: DataFrame, study: str, n_trials: int, seed: int = 0) -> DataFrame:
    """Drawn parameters of the other families: linear SVM, nearest neighbours, network."""
    trials = studies.select(study, F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial"))

    def u(name: str) -> Column:
        return draw(seed, name, study, "trial")

    lo, hi = MLP_UNITS
    n_layers = pick(u("layers"), MLP_LAYERS)
    units = [(F.floor(u(f"units_{i}") * (hi - lo + 1)) + lo).cast("int") for i in MLP_LAYERS]
    return trials.select(
        study,
        "trial",
        log_uniform(u("svm_c"), *SVM_C).alias("svm_c"),
        pick(u("class_weight"), CLASS_WEIGHTS).alias("class_weight"),
        pick(u("k"), NEIGHBOURS).alias("k"),
        pick(u("weights"), WEIGHTS).alias("weights"),
        pick(u("p"), POWERS).alias("p"),
        F.slice(F.array(*units), F.lit(1), n_layers).alias("mlp_units"),
        pick(u("batch"), MLP_BATCH).alias("batch_size"),
        log_uniform(u("rate"), *MLP_RATE).alias("learning_rate"),
    )


def fit_trials(trials: DataFrame, evaluate: Callable[[Row], float | None], spark: SparkSession) -> DataFrame:
    """(trial, value) for models that are fitted one by one; each fit is a Spark job of its own.

    A trial that cannot be fitted is left out, as a pruned trial is.
    """
    values = []
    for t in _drawn(trials):
        try:
            value = evaluate(t)
        except ValueError:
            continue
        if value is not None:
            values.append((t["trial"], float(value)))
    return spark.createDataFrame(values, "trial int, value double")


def _drawn(trials: DataFrame) -> list:
    """The trials on the driver: their number is a parameter of the search."""
    return trials.orderBy("trial").collect()


def _num(value: float) -> str:
    return f"{float(value)!r}D"


def _side(t, i: int, c: int) -> str:
    """SQL: weight of one unit of a term for class ``c`` under trial ``t``."""
    a = _num(t["alpha"])
    if t["classifier"] == "BernoulliNB":
        return f"(ln(p{c} + {a}) - ln(n.n{c} - p{c} + {a}))"
    of = 1 - c if t["classifier"] == "ComplementNB" else c
    share = f"ln((s{of} + {a}) / (t.t{of} + {a} * t.v))"
    return f"(-{share})" if t["classifier"] == "ComplementNB" else share


def _unit(t) -> str:
    """SQL: how much of its weight a present term counts."""
    return "CAST(lo = 0 AS DOUBLE)" if t["classifier"] == "BernoulliNB" else "(x - absent)"


def _spread(t, c: int, top: float) -> str:
    """SQL: smoothed variance of a term in class ``c``; missing where nothing varies at all."""
    return f"nullif(v{c} + {_num(t['var_smoothing'] * top)}, 0D)"


def _bell(t, x: str, top: float) -> str:
    """SQL: squared distances from the class means, in variances, class 1 less class 0."""
    one, two = (f"({x} - m{c}) * ({x} - m{c}) / {_spread(t, c, top)}" for c in (1, 0))
    return f"({one} - {two})"


def _margin(t, i: int, normed: bool, at: dict[str, str]) -> str:
    """SQL: score of class 1 minus score of class 0."""
    if normed:
        side = [f"(coalesce(z{c}_{i}, 0D) + {at[f'k{c}_{i}']}) / {at[f'a{c}_{i}']}" for c in (0, 1)]
        return f"{side[1]} - {side[0]}"
    prior = "0D"
    if t["classifier"] != "ComplementNB":
        prior = f"ln(1D - {_num(t['class_prior'])}) - ln({_num(t['class_prior'])})"
    return f"coalesce(z{i}, 0D) + {at[f'k{i}']} + {prior}"


def trial_scores(
    trials: DataFrame,
    stats: DataFrame,
    sizes: DataFrame,
    counts: DataFrame,
    docs: DataFrame,
    key: str,
) -> DataFrame:
    """Probability of every text of ``docs`` under every trial.

    ``stats`` are the training terms with moments. The trials become columns, ``GROUP_TRIALS`` of one plan: scored
    counts are read and summed once for a group, no row is multiplied. Bernoulli models see the
    binary features: a term is there or not, and one of all training texts never is.
    """
    drawn = _drawn(trials)
    groups = [drawn[i : i + GROUP_TRIALS] for i in range(0, len(drawn), GROUP_TRIALS)]
    parts = [_group_scores(g, stats, sizes, counts, docs, key) for g in groups]
    return reduce(DataFrame.union, parts)


def _group_scores(
    trials: list, stats: DataFrame, sizes: DataFrame, counts: DataFrame, docs: DataFrame, key: str
) -> DataFrame:
    drawn = list(enumerate(trials))
    bells = {i for i, t in drawn if t["classifier"] == "GaussianNB"}
    top = float(stats.agg(F.max("v")).first()[0] or 0.0) if bells else 0.0
    normed = {i for i, t in drawn if t["classifier"] == "ComplementNB" and t["norm"]}
    terms = stats.withColumns({f"p{c}": F.when(F.col("lo") == 0, F.col(f"k{c}")).otherwise(0) for c in (0, 1)})
    totals = one_row(
        stats.agg(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"), F.count(F.lit(1)).alias("v"))
    )
    ready = terms.withColumn("t", totals).withColumn("n", one_row(sizes))

    # A normalised complement model divides each class by its own sum of
    # weights; every other model only needs the difference of the classes.
    plain = [(i, t) for i, t in drawn if i not in normed and i not in bells]
    curved = [(i, t) for i, t in drawn if i in bells]
    apart = [(i, t, c) for i, t in drawn if i in normed for c in (0, 1)]
    weights = ready.selectExpr(
        "term",
        "lo",
        "span",
        "absent",
        *(["m0", "m1", "v0", "v1"] if curved else []),
        *[f"{_side(t, i, 1)} - {_side(t, i, 0)} AS d_{i}" for i, t in plain],
        *[f"{_side(t, i, c)} AS w{c}_{i}" for i, t, c in apart],
    )
    # What a text without any term gets. A Bernoulli model sums over every term, a
    # linear one only over those whose scaled value is not 0 where they lack.
    present = {i for i, t in plain if t["classifier"] == "BernoulliNB"}
    lack = [
        f"sum(ln((n.n1 - p1 + {a}) / (n.n1 + 2 * {a})) - ln((n.n0 - p0 + {a}) / (n.n0 + 2 * {a}))) AS k{i}"
        for i, t in plain
        if i in present
        for a in [_num(t["alpha"])]
    ]
    lack += [
        f"sum(-0.5D * (ln({_spread(t, 1, top)}) - ln({_spread(t, 0, top)}) + {_bell(t, 'absent', top)})) AS k{i}"
        for i, t in curved
    ]
    lack += [f"sum(abs({_side(t, i, c)})) AS a{c}_{i}" for i, t, c in apart]
    linear = [f"coalesce(sum(absent * d_{i}), 0D) AS k{i}" for i, t in plain if i not in present]
    linear += [f"coalesce(sum(absent * w{c}_{i}), 0D) AS k{c}_{i}" for i, t, c in apart]
    consts = [
        source.groupBy().agg(*[F.expr(x) for x in exprs])
        for source, exprs in ((ready, lack), (weights.filter("absent <> 0"), linear))
        if exprs
    ]
    per_text = (
        counts.select(key, "term", "n")
        .join(weights, "term")
        .withColumn("x", scaled())
        .groupBy(key)
        .agg(
            *[F.expr(f"sum({_unit(t)} * d_{i}) AS z{i}") for i, t in plain],
            *[F.expr(f"sum(-0.5D * ({_bell(t, 'x', top)} - {_bell(t, 'absent', top)})) AS z{i}") for i, t in curved],
            *[F.expr(f"sum({_unit(t)} * w{c}_{i}) AS z{c}_{i}") for i, t, c in apart],
        )
    )
    joined = docs.join(per_text, key, "left")
    at = {}
    for j, part in enumerate(consts):
        joined = joined.withColumn(f"_c{j}", one_row(part))
        at.update({c: f"_c{j}.{c}" for c in part.columns})
    cells = ", ".join(
        f"struct({t['trial']} AS trial, 1D / (1D + exp(-({_margin(t, i, i in normed, at)}))) AS prob)"
        for i, t in drawn
    )
    return joined.selectExpr(*docs.columns, f"inline(array({cells}))")


def evaluate_trials(scores: DataFrame, label: str) -> DataFrame:
    """AUC of every trial."""
    return auc(scores, label, "prob", ["trial"]).withColumnRenamed("auc", "value")


def best_trial(trials: DataFrame, values: DataFrame, study: str) -> DataFrame:
    """The trial with the largest value per study; the lowest number on a tie."""
    return best_per_group(trials.join(values, "trial"), [study], "value", "trial")


def results_to_trials(
    results: DataFrame, run: Sequence[str], metric: str, parameters: Sequence[str]
) -> DataFrame:
    """Validation rows as (run, params map, value); parameters without a choice are left out.

    Which parameters vary is decided inside the plan from their minimum and maximum.
    """
    val = results.filter(F.col("dataset_type") == "val")
    varies = val.agg(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.min(F.col(p).cast("string")) < F.max(F.col(p).cast("string")), F.lit(p)
                    )
                    for p in parameters
                ]
            )
        ).alias("names")
    ).scalar()
    pairs = [x for p in parameters for x in (F.lit(p), F.col(p).cast("string"))]
    full = val.withColumn("_keep", varies).withColumn("_all", F.create_map(*pairs))
    params = F.map_filter("_all", lambda k, v: F.array_contains(F.col("_keep"), k))
    return full.select(*run, params.alias("params"), F.col(metric).alias("value"))


def ladder_fits(
    train_counts: DataFrame,
    ladder: DataFrame,
    counts: DataFrame,
    docs: DataFrame,
    key: str,
    label: str,
    n_sizes: int,
    alpha: float = 1.0,
    var_smoothing: float = 0.01,
) -> DataFrame:
    """Probabilities of ``docs`` by naive Bayes models of every sample size, fitted in one scan.

    ``ladder`` (key, label, step): the first of the nested samples, numbered from 0, that holds a training row. Counts are
    summed once per (term, step); a sample's sums are those of its step and all before. Returns (``docs``, step,
    classifier, prob). A sample without one of the classes has no probabilities.
    """
    up = F.explode(F.sequence(F.col("step"), F.lit(n_sizes - 1)))
    one, two = F.col(label) == 0, F.col(label) == 1
    sizes = (
        ladder.groupBy("step")
        .agg(F.count_if(one).alias("n0"), F.count_if(two).alias("n1"))
        .select(up.alias("step"), "n0", "n1")
        .groupBy("step")
        .agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"))
    )
    sums = {}
    for c, is_class in enumerate((one, two)):
        n = F.when(is_class, F.col("n")).otherwise(0)
        sums |= {f"k{c}": F.count_if(is_class), f"t{c}": F.sum(n), f"u{c}": F.sum(n * n)}
    found = train_counts.select(key, "term", "n").join(ladder, key).groupBy("term", "step").agg(
        *[v.alias(k) for k, v in sums.items()], F.min("n").alias("n_min"), F.max("n").alias("n_max")
    )
    running = found.select("term", up.alias("step"), *[c for c in found.columns if c not in ("term", "step")])
    running = running.groupBy("term", "step").agg(
        *[F.sum(k).alias(k) for k in sums], F.min("n_min").alias("n_min"), F.max("n_max").alias("n_max")
    )
    whole = running.join(sizes, "step").withColumn(
        "lo", F.expr("if(k0 + k1 < n0 + n1, 0, n_min)")
    ).withColumn("span", F.col("n_max") - F.col("lo"))
    shares = {"absent": "if(span = 0, 0D, -lo / span)"}
    for c in (0, 1):
        shares |= {
            f"s{c}": f"if(span = 0, 0D, (t{c} - k{c} * lo) / span)",
            f"p{c}": f"if(lo = 0, k{c}, 0)",
            f"m{c}": f"if(span = 0, 0D, (t{c} / nullif(n{c}, 0) - lo) / span)",
            f"v{c}": f"if(span = 0, 0D, (u{c} / nullif(n{c}, 0) - pow(t{c} / nullif(n{c}, 0), 2)) / (span * span))",
        }
    shares["v"] = "if(span = 0, 0D, ((u0 + u1) / (n0 + n1) - pow((t0 + t1) / (n0 + n1), 2)) / (span * span))"
    stats = materialise(
        whole.selectExpr("term", "step", "lo", "span", "n0", "n1", *[f"{v} AS {k}" for k, v in shares.items()]), "ladder_terms"
    )
    totals = stats.groupBy("step").agg(
        F.sum("s0").alias("z0"), F.sum("s1").alias("z1"), F.count(F.lit(1)).alias("v_n"), (F.max("v") * var_smoothing).alias("e")
    )
    a = _num(alpha)
    weights = stats.join(totals, "step").selectExpr(
        "term", "step", "lo", "span", "absent", "m0", "m1", "v0 + e AS v0", "v1 + e AS v1", "n0", "n1", "p0", "p1",
        f"ln((s1 + {a}) / (z1 + {a} * v_n)) - ln((s0 + {a}) / (z0 + {a} * v_n)) AS wm",
        f"ln(p1 + {a}) - ln(n1 - p1 + {a}) - ln(p0 + {a}) + ln(n0 - p0 + {a}) AS wb",
    )

    def bell(x: str) -> str:
        return f"(-0.5D * (pow({x} - m1, 2) / nullif(v1, 0D) - pow({x} - m0, 2) / nullif(v0, 0D)))"

    base = weights.groupBy("step").agg(
        F.expr("sum(absent * wm)").alias("bm"),
        F.expr(f"sum(ln((n1 - p1 + {a}) / (n1 + 2 * {a})) - ln((n0 - p0 + {a}) / (n0 + 2 * {a})))").alias("bb"),
        F.expr(f"sum({bell('absent')} - 0.5D * (ln(v1) - ln(v0)))").alias("bg"),
        F.expr("ln(max(n1)) - ln(max(n0))").alias("prior"),
    )
    per_text = (
        counts.select(key, "term", "n")
        .join(weights, "term")
        .withColumn("x", scaled())
        .groupBy("step", key)
        .agg(
            F.expr("sum((x - absent) * wm)").alias("zm"),
            F.expr("sum(if(lo = 0, wb, 0D))").alias("zb"),
            F.expr(f"sum({bell('x')} - {bell('absent')})").alias("zg"),
        )
    )
    every = docs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_sizes - 1))))
    joined = every.join(per_text, ["step", key], "left").join(base, "step")
    cells = [
        f"struct('{name}' AS classifier, 1D / (1D + exp(-(coalesce(z{c}, 0D) + b{c} + prior))) AS prob)"
        for name, c in (("MultinomialNB", "m"), ("BernoulliNB", "b"), ("GaussianNB", "g"))
    ]
    return joined.selectExpr(*docs.columns, "step", f"inline(array({', '.join(cells)}))").filter("prob is not null")


def learning_curve(results: DataFrame) -> DataFrame:
    """Mean AUC by algorithm, sample size and split, in long form."""
    means = results.groupBy("classifier", "n_samples").agg(
        F.avg("auc_val").alias("val"), F.avg("auc_test").alias("test")
    )
    return means.unpivot(["classifier", "n_samples"], ["val", "test"], "split", "auc")
