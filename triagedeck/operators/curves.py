"""ROC curves, AUC, best thresholds, early stopping, axis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ranks import running_totals


def score_counts(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*group, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )


def _counts(df: DataFrame, label: str, score: str, group: Sequence[str]) -> DataFrame:
    """The counts per score, written once: whatever computed the scores runs a single time."""
    return materialise(score_counts(df, label, score, group), "scores")


def _curve(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Running (tp, fp) down the scores, beside the totals of the group.

    Totals come with the offsets of the ranges, so rows meet them by (group, range) and a
    group that holds most scores is spread like any other.
    """
    return running_totals(
        counts, "threshold", {"tp": "_pos", "fp": "_neg"}, group, True, totals={"tp": "n_pos", "fp": "n_neg"}
    )


def roc_points(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, and the start (0, 0) at an infinite threshold."""
    counts = _counts(df, label, score, group)
    curve = _curve(counts, group)
    points = curve.select(
        *group,
        "threshold",
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    start = counts.groupBy(*group).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def auc(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve.

    Each score adds its negatives times the positives above it, ties by half:
    the trapezoids of the curve without looking at the previous row. Null if a class is missing.
    """
    curve = _curve(_counts(df, label, score, group), group)
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0))
    return curve.groupBy(*group).agg(
        F.try_divide(area, F.max("n_pos") * F.max("n_neg")).alias("auc")
    )


def best_threshold(
    df: DataFrame, label: str, score: str, group: Sequence[str] = ()
) -> DataFrame:
    """Threshold with the best accuracy; the highest one on a tie.

    Predicting nothing as severe (an infinite threshold) is a candidate.
    """
    curve = _curve(_counts(df, label, score, group), group)
    scored = curve.select(
        *group,
        (F.col("tp") + F.col("n_neg") - F.col("fp")).alias("right"),
        "threshold",
        (F.col("n_pos") + F.col("n_neg")).alias("size"),
        "n_neg",
    )
    best = scored.groupBy(*group).agg(
        F.max(F.struct("right", "threshold")).alias("b"),
        F.max("size").alias("size"),
        F.max("n_neg").alias("none"),
    )
    empty = F.col("none") >= F.col("b.right")
    return best.select(
        *group,
        F.when(empty, F.lit(float("inf"))).otherwise(F.col("b.threshold")).alias("threshold"),
        (F.greatest("none", F.col("b.right")) / F.col("size")).alias("accuracy"),
    )


def early_stop(
    losses: DataFrame,
    run: Sequence[str],
    epoch: str,
    loss: str,
    patience: int,
    min_gain: float = 0.0,
    rule: str = "gain",
) -> DataFrame:
    """Epoch at which training would stop (null: never), and the best loss by then.

    ``losses`` holds one row per run and epoch, so a run's history is a short
    array. Rule ``gain``: better means lower by more than ``min_gain``. Rule
    ``score``: worse means the negated loss is below best + ``min_gain``.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).cast("double").alias("l"))))
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("bad"),
        F.lit(None).cast("long").alias("stop"),
    )

    def step(s, x):
        if rule == "gain":
            better = s["best"].isNull() | (
                (x["l"] < s["best"]) & (F.abs(x["l"] - s["best"]) > F.lit(min_gain))
            )
        else:
            better = s["best"].isNull() | ~(-x["l"] < -s["best"] + F.lit(min_gain))
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        return F.when(s["stop"].isNotNull(), s).otherwise(
            F.struct(
                F.when(better, x["l"]).otherwise(s["best"]).alias("best"),
                bad.alias("bad"),
                F.when(bad >= patience, x["e"].cast("long")).alias("stop"),
            )
        )

    folded = losses.groupBy(*run).agg(steps.alias("_steps"))
    folded = folded.withColumn("_s", F.aggregate("_steps", start, step))
    return folded.select(
        *run, F.col("_s.stop").alias("stop_epoch"), F.col("_s.best").alias("best_loss")
    )


def parallel_axes(trials: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """Codes of categorical parameters for a parallel-axes view: (parameter, choice, code, best).

    Trials without the parameter are left out. Distinct choices are found
    first, so the ranking runs over choices, not over trials.
    """
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("parameter"), F.col("params").getItem(n).alias("choice"))
            for n in names
        ]
    )
    long = trials.select(F.col(value).alias("_v"), F.inline(cells)).filter("choice is not null")
    choices = long.groupBy("parameter", "choice").agg(
        F.max("_v").alias("best"), F.count(F.lit(1)).alias("n_trials")
    )
    w = Window.partitionBy("parameter").orderBy("choice")
    return choices.withColumn("code", F.dense_rank().over(w) - 1)


def run_summary(df: DataFrame, label: str, score: str, group: Sequence[str]) -> DataFrame:
    """Per run: AUC, best threshold and the matrix, accuracy and F1 at that threshold.

    Everything is read off one curve, so the scores are shuffled once.
    """
    curve = _curve(_counts(df, label, score, group), group)
    p, n = F.col("n_pos"), F.col("n_neg")
    rows = curve.select(
        *group,
        "threshold",
        "tp",
        "fp",
        "n_pos",
        "n_neg",
        (F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0)).alias("area"),
        (F.col("tp") + n - F.col("fp")).alias("right"),
    )
    best = rows.groupBy(*group).agg(
        F.sum("area").alias("area"),
        F.max(F.struct("right", "threshold", "tp", "fp")).alias("b"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    none = n >= F.col("b.right")
    tp = F.when(none, F.lit(0)).otherwise(F.col("b.tp"))
    fp = F.when(none, F.lit(0)).otherwise(F.col("b.fp"))
    flagged = tp + fp + p
    return best.select(
        *group,
        F.try_divide(F.col("area"), p * n).alias("auc"),
        F.when(none, F.lit(float("inf"))).otherwise(F.col("b.threshold")).alias("threshold"),
        ((tp + n - fp) / (p + n)).alias("accuracy"),
        (n - fp).alias("tn"),
        fp.alias("fp"),
        (p - tp).alias("fn"),
        tp.alias("tp"),
        F.when(flagged == 0, F.lit(0.0)).otherwise(2.0 * tp / flagged).alias("f1_severe"),
    )
