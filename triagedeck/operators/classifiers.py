"""Kernel features, networks, records of fitted classifiers, and batch scoring."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as tx
from ..functions.numbers import FAILED
from .curves import auc
from .metrics import accuracy

def hash_normals(seed: int, name: str, rows: int, columns: int) -> np.ndarray:
    """Standard normal numbers that any engine with md5 can repeat: Box and Muller's pairs of hashed uniform ones."""

    def uniform(part: str) -> np.ndarray:
        keys = (f"{seed}|{name}_{part}|{i}|{j}" for i in range(1, rows + 1) for j in range(1, columns + 1))
        found = [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) for k in keys]
        return np.array(found, dtype=np.float64).reshape(rows, columns)

    return np.sqrt(-2.0 * np.log((uniform("r") + 1.0) / 4294967297.0)) * np.cos(2.0 * np.pi * uniform("a") / 4294967296.0)


def fourier_features(
    df: DataFrame, key: str, vector: str, dim: int, n_features: int = 256, gamma: float = 0.001, seed: int = 0
) -> DataFrame:
    """Random Fourier features of an RBF kernel (Rahimi & Recht 2007), long: (key, term, x), terms from 0.

    The projection is derived from the seed in every task, so nothing is shipped.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.sqrt(2.0 * gamma) * hash_normals(seed, "fourier", dim, n_features)
        turn = [hashlib.md5(f"{seed}|turn|{j}".encode()).hexdigest()[:8] for j in range(1, n_features + 1)]
        b = 2.0 * np.pi * np.array([int(x, 16) for x in turn]) / 4294967296.0
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in batch])
            yield pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(x @ w + b)))

    return df.select(key, F.posexplode(project(F.col(vector))).alias("term", "x"))


def fit_mlp(
    train: DataFrame, label: str, layers: Sequence[int], max_iter: int = 100, step: float = 0.03, seed: int = 0
):
    """Multilayer perceptron on a ``features`` vector."""
    return MultilayerPerceptronClassifier(
        labelCol=label, layers=list(layers), maxIter=max_iter, stepSize=step, seed=seed
    ).fit(train)


def train_valid_test(scored: DataFrame, label: str, classifier: str) -> DataFrame:
    """One record per classifier: accuracy on train, AUC on validation and on test.

    ``scored``: rows of all three sets with ``split``, ``prob`` and ``pred``.
    The scored rows themselves stay a table (see ``sources.sinks``); a record refers to them.
    """
    areas = auc(scored.filter(F.col("split") != "tr"), label, "prob", ["split"])
    wide = areas.agg(
        F.max(F.when(F.col("split") == "val", F.col("auc"))).alias("auc_val"),
        F.max(F.when(F.col("split") == "test", F.col("auc"))).alias("auc_test"),
    ).select(F.struct("auc_val", "auc_test").alias("a"))
    train = accuracy(scored.filter(F.col("split") == "tr"), label, "pred")
    return (
        train.select(F.lit(classifier).alias("classifier"), F.col("accuracy").alias("train_accuracy"))
        .withColumn("a", wide.scalar())
        .select("classifier", "train_accuracy", "a.auc_val", "a.auc_test")
    )


def score_prompts(
    df: DataFrame,
    prompt: str,
    make_scorer: Callable[[], Callable[[list[str]], list[str | None]]],
    tries: int = 2,
    batch_rows: int = 32,
) -> DataFrame:
    """Answers of an external batch model, the tries they took, and the label read from them.

    ``make_scorer`` loads the model once per task and returns a function from prompts to answers.
    It is called with at most ``batch_rows`` prompts and must return as many answers. A batch that
    fails ``tries`` times is scored prompt by prompt; a prompt that fails ``tries`` times alone
    has no answer and gets the failed code, and the others of its batch keep theirs. A null prompt
    is never sent and fails at once. A scorer that cannot be loaded fails the task, so that Spark repeats it
    elsewhere. Adds ``answer``, ``n_tries`` (calls that held the prompt) and ``severity_pred``.
    """
    if tries < 1 or batch_rows < 1:
        raise ValueError("tries and batch_rows are at least 1")
    schema = StructType(
        [*df.schema.fields, StructField("answer", StringType()), StructField("n_tries", LongType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()

        def attempt(texts: list[str]) -> tuple[list[str | None] | None, int]:
            for n in range(1, tries + 1):
                try:
                    answers = list(score(texts))
                    if len(answers) == len(texts):
                        return answers, n
                except Exception:  # whatever the model raises costs a try
                    continue
            return None, tries

        def answered(texts: list[str]) -> list[tuple[str | None, int]]:
            answers, n = attempt(texts)
            if answers is not None:
                return [(a, n) for a in answers]
            if len(texts) == 1:
                return [(None, n)]
            alone = [attempt([t]) for t in texts]
            return [(a[0] if a else None, n + m) for a, m in alone]

        for pdf in batches:
            texts = pdf[prompt].tolist()
            sent = [i for i, t in enumerate(texts) if isinstance(t, str)]
            found: list[tuple[str | None, int]] = [(None, 0)] * len(texts)
            for start in range(0, len(sent), batch_rows):
                at = sent[start : start + batch_rows]
                for i, got in zip(at, answered([texts[i] for i in at])):
                    found[i] = got
            yield pdf.assign(
                answer=pd.Series([a for a, _ in found], index=pdf.index, dtype=object),
                n_tries=pd.Series([n for _, n in found], index=pdf.index, dtype="int64"),
            )

    answered = df.mapInPandas(run, schema)
    return answered.withColumn(
        "severity_pred",
        F.when(F.col("answer").isNull(), F.lit(FAILED)).otherwise(tx.classify_answer(F.col("answer"))),
    )
