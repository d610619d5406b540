"""Naive Bayes from sums per (term, class), scored by a join on the term.

Texts come as counts (key, label, term, n). The sums of the min-max scaled counts follow from the
sums, smallest and largest of the plain ones, so training reads the counts once
and leaves one row per term. Scoring adds, per text, what each of its terms changes against
a text without any: no row ever stands for an absent term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

TWO_PI = 6.283185307179586


@dataclass(frozen=True)
class Prior:
    """Given class shares, else training frequencies, else equal shares."""

    fit: bool = True
    given: Sequence[float] | None = None

    def log(self, n0: Column, n1: Column) -> tuple[Column, Column]:
        if self.given is not None:
            return tuple(F.log(F.lit(float(p))) for p in self.given)
        if self.fit:
            total = n0 + n1
            return F.log(n0 / total), F.log(n1 / total)
        return F.log(F.lit(0.5)), F.log(F.lit(0.5))


@dataclass(frozen=True)
class TermModel:
    """Rows per term, one row of constants (b0, b1), and what a present term adds to class c."""

    weights: DataFrame
    base: DataFrame
    gain: Callable[[int], Column]


def class_sizes(docs: DataFrame, label: str) -> DataFrame:
    return docs.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value inside another query."""
    return df.select(F.struct(*df.columns).alias("r")).scalar()


def scaled() -> Column:
    """Min-max scaled count; a term that never varies gives 0."""
    return F.when(F.col("span") == 0, F.lit(0.0)).otherwise((F.col("n") - F.col("lo")) / F.col("span"))


def term_stats(
    train_counts: DataFrame, sizes: DataFrame, label: str, moments: bool = False
) -> DataFrame:
    """Range, scaled sums and number of texts per class of every training term.

    ``absent`` is the scaled value of a text without the term: 0 unless every
    training text has it. ``moments`` adds means and population variances. The
    result is written once; totals and weights are read from there.
    """
    is_class = {str(c): F.col(label) == c for c in (0, 1)}
    aggs = [F.min("n").alias("n_min"), F.max("n").alias("n_max")]
    for c, cond in is_class.items():
        aggs += [
            F.count_if(cond).alias(f"k{c}"),
            F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"t{c}"),
        ]
    if moments:
        for c, x in {"": F.col("n"), **{c: F.when(k, F.col("n")) for c, k in is_class.items()}}.items():
            aggs += [
                F.coalesce(F.avg(x), F.lit(0.0)).alias(f"a{c}"),
                F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"q{c}"),
            ]
    found = train_counts.groupBy("term").agg(*aggs).withColumn("n", one_row(sizes))
    size = {"0": F.col("n.n0"), "1": F.col("n.n1"), "": F.col("n.n0") + F.col("n.n1")}
    seen = F.col("k0") + F.col("k1")
    found = found.withColumn("lo", F.when(seen < size[""], F.lit(0)).otherwise(F.col("n_min")))
    span = F.col("n_max") - F.col("lo")

    def scale(v: Column, shift: Column) -> Column:
        return F.when(span == 0, F.lit(0.0)).otherwise((v - shift) / span)

    cols = {
        "term": F.col("term"),
        "lo": F.col("lo"),
        "span": span,
        "absent": scale(F.lit(0), F.col("lo")),
        "k0": F.col("k0"),
        "k1": F.col("k1"),
        "s0": scale(F.col("t0"), F.col("k0") * F.col("lo")),
        "s1": scale(F.col("t1"), F.col("k1") * F.col("lo")),
    }
    if moments:
        for c, n in size.items():
            # The texts without the term join as a block of zeros.
            k = seen if c == "" else F.col(f"k{c}")
            mean = k * F.col(f"a{c}") / n
            var = (k * F.col(f"q{c}") + k * (n - k) / n * F.col(f"a{c}") * F.col(f"a{c}")) / n
            cols[f"m{c}"] = scale(mean, F.col("lo"))
            cols[f"v{c}"] = F.when(span == 0, F.lit(0.0)).otherwise(var / (span * span))
    return materialise(found.select(*[c.alias(name) for name, c in cols.items()]), "terms")


def _totals(stats: DataFrame) -> Column:
    return one_row(
        stats.agg(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"), F.count(F.lit(1)).alias("v"))
    )


def _linear(weights: DataFrame, base: DataFrame | None, anchor: DataFrame) -> TermModel:
    """Weights w0, w1 per unit of the scaled count."""
    extra = one_row(
        weights.agg(*[F.coalesce(F.sum(F.col("absent") * F.col(f"w{c}")), F.lit(0.0)).alias(f"e{c}") for c in (0, 1)])
    )
    start = base if base is not None else anchor.select(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    shifted = start.withColumn("e", extra)
    return TermModel(
        weights,
        shifted.select(*[(F.col(f"b{c}") + F.col(f"e.e{c}")).alias(f"b{c}") for c in (0, 1)]),
        lambda c: (scaled() - F.col("absent")) * F.col(f"w{c}"),
    )


def _priors(sizes: DataFrame, prior: Prior) -> DataFrame:
    b0, b1 = prior.log(F.col("n0"), F.col("n1"))
    return sizes.select(b0.alias("b0"), b1.alias("b1"))


def fit_multinomial(
    stats: DataFrame, sizes: DataFrame, alpha: float = 1.0, prior: Prior = Prior()
) -> TermModel:
    def weight(c: int) -> Column:
        return F.log(F.col(f"s{c}") + alpha) - F.log(F.col(f"t.t{c}") + alpha * F.col("t.v"))

    weights = stats.withColumn("t", _totals(stats)).select(
        "term", "lo", "span", "absent", weight(0).alias("w0"), weight(1).alias("w1")
    )
    return _linear(weights, _priors(sizes, prior), sizes)


def fit_complement(
    stats: DataFrame, sizes: DataFrame, alpha: float = 1.0, norm: bool = False
) -> TermModel:
    """Weights of a class come from the other class; priors play no part."""

    def weight(other: int) -> Column:
        return -F.log((F.col(f"s{other}") + alpha) / (F.col(f"t.t{other}") + alpha * F.col("t.v")))

    weights = stats.withColumn("t", _totals(stats)).select(
        "term", "lo", "span", "absent", weight(1).alias("w0"), weight(0).alias("w1")
    )
    if norm:
        size = one_row(
            weights.agg(F.sum(F.abs("w0")).alias("a0"), F.sum(F.abs("w1")).alias("a1"))
        )
        weights = weights.withColumn("a", size).select(
            "term", "lo", "span", "absent", *[(F.col(f"w{c}") / F.col(f"a.a{c}")).alias(f"w{c}") for c in (0, 1)]
        )
    return _linear(weights, None, sizes)


def texts_above(
    train_counts: DataFrame, stats: DataFrame, label: str, cuts: dict[str, float]
) -> DataFrame:
    """Texts per class whose scaled count exceeds each named cut: columns c0_<name>, c1_<name>."""
    ranged = train_counts.join(stats.select("term", "lo", "span"), "term")
    return ranged.groupBy("term").agg(
        *[
            F.count_if((scaled() > cut) & (F.col(label) == c)).alias(f"c{c}_{name}")
            for name, cut in cuts.items()
            for c in (0, 1)
        ]
    )


def fit_bernoulli(
    train_counts: DataFrame,
    stats: DataFrame,
    sizes: DataFrame,
    label: str,
    alpha: float = 1.0,
    binarize: float = 0.0,
    prior: Prior = Prior(),
) -> TermModel:
    """Presence means a scaled count above ``binarize``.

    Absent terms are summed once for all texts; a present term replaces its share.
    """
    hits = materialise(texts_above(train_counts, stats, label, {"x": binarize}), "hits")

    def share(c: int, n: Column) -> Column:
        return F.log((n + alpha) / (F.col(f"n.n{c}") + 2 * alpha))

    logs = hits.withColumn("n", one_row(sizes)).select(
        "term",
        *[share(c, F.col(f"c{c}_x")).alias(f"yes{c}") for c in (0, 1)],
        *[share(c, F.col(f"n.n{c}") - F.col(f"c{c}_x")).alias(f"no{c}") for c in (0, 1)],
    )
    absent = one_row(logs.agg(F.sum("no0").alias("a0"), F.sum("no1").alias("a1")))
    base = _priors(sizes, prior).withColumn("a", absent)
    weights = logs.select(
        "term", *[(F.col(f"yes{c}") - F.col(f"no{c}")).alias(f"w{c}") for c in (0, 1)]
    )
    return TermModel(
        stats.select("term", "lo", "span").join(weights, "term"),
        base.select(*[(F.col(f"b{c}") + F.col(f"a.a{c}")).alias(f"b{c}") for c in (0, 1)]),
        lambda c: (scaled() > binarize).cast("double") * F.col(f"w{c}"),
    )


def fit_presence(
    stats: DataFrame, sizes: DataFrame, alpha: float = 1.0, prior: Prior = Prior()
) -> TermModel:
    """Bernoulli model of the binary features, from the same statistics as the others.

    Min-max scaled, a term is 1 where it occurs and 0 elsewhere, and 0 everywhere if all training texts have it.
    """

    def share(c: int, n: Column) -> Column:
        return F.log((n + alpha) / (F.col(f"n.n{c}") + 2 * alpha))

    seen = [F.when(F.col("lo") == 0, F.col(f"k{c}")).otherwise(0) for c in (0, 1)]
    logs = stats.withColumn("n", one_row(sizes)).select(
        "term",
        "lo",
        "span",
        *[share(c, seen[c]).alias(f"yes{c}") for c in (0, 1)],
        *[share(c, F.col(f"n.n{c}") - seen[c]).alias(f"no{c}") for c in (0, 1)],
    )
    absent = one_row(logs.agg(F.sum("no0").alias("a0"), F.sum("no1").alias("a1")))
    base = _priors(sizes, prior).withColumn("a", absent)
    return TermModel(
        logs.select("term", "lo", "span", *[(F.col(f"yes{c}") - F.col(f"no{c}")).alias(f"w{c}") for c in (0, 1)]),
        base.select(*[(F.col(f"b{c}") + F.col(f"a.a{c}")).alias(f"b{c}") for c in (0, 1)]),
        lambda c: (F.col("lo") == 0).cast("double") * F.col(f"w{c}"),
    )


def fit_gaussian_terms(
    stats: DataFrame, sizes: DataFrame, var_smoothing: float = 1e-9, prior: Prior = Prior()
) -> TermModel:
    """Normal densities per term; ``stats`` with moments."""
    extra = stats.agg((F.max("v") * var_smoothing).alias("e")).scalar()
    weights = stats.withColumn("e", extra).select(
        "term",
        "lo",
        "span",
        "absent",
        *[c for i in (0, 1) for c in (F.col(f"m{i}"), (F.col(f"v{i}") + F.col("e")).alias(f"v{i}"))],
    )

    def square(x: Column, c: int) -> Column:
        return F.pow(x - F.col(f"m{c}"), F.lit(2.0)) / F.col(f"v{c}")

    nothing = one_row(
        weights.agg(
            *[
                F.sum(F.lit(-0.5) * (F.log(TWO_PI * F.col(f"v{c}")) + square(F.col("absent"), c))).alias(f"e{c}")
                for c in (0, 1)
            ]
        )
    )
    base = _priors(sizes, prior).withColumn("e", nothing)
    return TermModel(
        weights,
        base.select(*[(F.col(f"b{c}") + F.col(f"e.e{c}")).alias(f"b{c}") for c in (0, 1)]),
        lambda c: F.lit(-0.5) * (square(scaled(), c) - square(F.col("absent"), c)),
    )


def with_verdict(scored: DataFrame, z0: Column, z1: Column) -> DataFrame:
    """Add the class scores, the probability of class 1 and the predicted class."""
    return scored.withColumns({"z0": z0, "z1": z1}).withColumns(
        {
            "prob": probability(F.col("z0"), F.col("z1")),
            "pred": (F.col("z1") > F.col("z0")).cast("int"),
        }
    )


def score(model: TermModel, counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``z0``, ``z1``, ``prob`` and ``pred``; a text without known terms gets the base."""
    sums = (
        counts.select(key, "term", "n")
        .join(model.weights, "term")
        .groupBy(key)
        .agg(*[F.sum(model.gain(c)).alias(f"_z{c}") for c in (0, 1)])
    )
    joined = docs.join(sums, key, "left").withColumn("_b", one_row(model.base))
    z = [F.coalesce(F.col(f"_z{c}"), F.lit(0.0)) + F.col(f"_b.b{c}") for c in (0, 1)]
    return with_verdict(joined, *z).drop("_z0", "_z1", "_b")


def probability(z0: Column, z1: Column) -> Column:
    """Share of class 1 for two log scores."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z0 - z1))


def fit_gaussian(
    train: DataFrame, label: str, vector: str, var_smoothing: float = 1e-9
) -> DataFrame:
    """(dim, m0, v0, m1, v1): mean and smoothed population variance per class."""
    cells = train.select(label, F.posexplode(vector).alias("dim", "_x")).withColumn(
        "_x", F.col("_x").cast("double")
    )
    stats = cells.groupBy("dim").agg(
        *[F.avg(F.when(F.col(label) == c, F.col("_x"))).alias(f"m{c}") for c in (0, 1)],
        *[F.var_pop(F.when(F.col(label) == c, F.col("_x"))).alias(f"v{c}") for c in (0, 1)],
        F.var_pop("_x").alias("v"),
    )
    extra = stats.agg((F.max("v") * var_smoothing).alias("e")).scalar()
    return stats.select(
        "dim", "m0", (F.col("v0") + extra).alias("v0"), "m1", (F.col("v1") + extra).alias("v1")
    )


def score_gaussian(
    model: DataFrame, sizes: DataFrame, docs: DataFrame, vector: str, prior: Prior = Prior()
) -> DataFrame:
    """Log likelihoods folded over each row's own vector; the model is one array of the vector's width."""
    row = model.agg(
        F.array_sort(F.collect_list(F.struct("dim", "m0", "v0", "m1", "v1"))).alias("m")
    ).scalar()
    ready = docs.withColumn("_m", row).withColumn("_b", one_row(_priors(sizes, prior)))

    def log_likelihood(c: int) -> Column:
        parts = F.zip_with(
            F.col(vector),
            F.col("_m"),
            lambda x, m: F.log(m[f"v{c}"] * F.lit(TWO_PI))
            + F.pow(x.cast("double") - m[f"m{c}"], F.lit(2.0)) / m[f"v{c}"],
        )
        return F.lit(-0.5) * F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

    z = [log_likelihood(c) + F.col(f"_b.b{c}") for c in (0, 1)]
    return with_verdict(ready, *z).drop("_m", "_b")


def cross_validate(
    counts: DataFrame, folds: DataFrame, key: str, label: str, alpha: float = 1.0
) -> DataFrame:
    """Multinomial scores of every text by the model of the other folds, for every seed.

    A fold's training sums are the totals minus its own sums, so the counts are summed
    once however many folds there are. ``folds``: (seed, fold, key, label).
    """
    rows = counts.select(key, "term", "n").join(folds.select("seed", "fold", key, label), key)
    own = materialise(
        rows.groupBy("seed", "fold", "term").agg(
            *[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"o{c}") for c in (0, 1)]
        ),
        "folds",
    )
    all_ = own.groupBy("seed", "term").agg(*[F.sum(f"o{c}").alias(f"a{c}") for c in (0, 1)])
    seed_sums = all_.groupBy("seed").agg(
        *[F.sum(f"a{c}").alias(f"fa{c}") for c in (0, 1)], F.count(F.lit(1)).alias("v")
    )
    fold_sums = own.groupBy("seed", "fold").agg(*[F.sum(f"o{c}").alias(f"fo{c}") for c in (0, 1)])
    fold_docs = folds.groupBy("seed", "fold").agg(
        *[F.count_if(F.col(label) == c).alias(f"nf{c}") for c in (0, 1)]
    )
    seed_docs = fold_docs.groupBy("seed").agg(*[F.sum(f"nf{c}").alias(f"ns{c}") for c in (0, 1)])
    rest = F.col("ns0") - F.col("nf0") + F.col("ns1") - F.col("nf1")
    consts = (
        fold_sums.join(seed_sums, "seed")
        .join(fold_docs, ["seed", "fold"])
        .join(seed_docs, "seed")
        .select(
            "seed",
            "fold",
            *[F.log(F.col(f"fa{c}") - F.col(f"fo{c}") + alpha * F.col("v")).alias(f"t{c}") for c in (0, 1)],
            *[F.log((F.col(f"ns{c}") - F.col(f"nf{c}")) / rest).alias(f"p{c}") for c in (0, 1)],
        )
    )
    weights = own.join(all_, ["seed", "term"]).select(
        "seed",
        "fold",
        "term",
        *[F.log(F.col(f"a{c}") - F.col(f"o{c}") + alpha).alias(f"w{c}") for c in (0, 1)],
    )
    sums = (
        rows.join(weights, ["seed", "fold", "term"])
        .groupBy("seed", "fold", key, label)
        .agg(
            *[F.sum(F.col("n") * F.col(f"w{c}")).alias(f"s{c}") for c in (0, 1)],
            F.sum("n").alias("len"),
        )
    )
    scored = sums.join(consts, ["seed", "fold"])
    z = [F.col(f"s{c}") - F.col("len") * F.col(f"t{c}") + F.col(f"p{c}") for c in (0, 1)]
    return with_verdict(scored, *z).select("seed", "fold", key, label, "prob", "pred")
