"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import query, table

SAMPLE_DOCS = 4000  # labelled documents that the model is fitted on, at most
SAMPLE_BYTES = 24_000_000  # of their texts, at most
LARGEST = 1 / 50  # of these bytes, that one text of the sample may have
STEP_BYTES = 1_000_000  # of texts whose passages are made at once
PASSAGE = 512  # bytes
TRIGRAMS = 256  # hashed kinds of three bytes
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 4e-3, 1e-4
THRESHOLD = 0.3

# Kinds of bytes: every ASCII mark is one, letters, digits and the bytes of other characters are grouped.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kinds[b] = 1 if b < 192 else 2
        elif c.isalpha():
            kinds[b] = 3 + c.isupper() + 2 * (c in "aeiou")
        elif c.isdigit():
            kinds[b] = 6
        elif c == " ":
            kinds[b] = 7
        elif c in "\n\r":
            kinds[b] = 8
        elif b in MARKS:
            kinds[b] = 9 + MARKS.index(b) % 7
    return kinds


KINDS = byte_kinds()
N_KINDS = int(KINDS.max()) + 1
N_FEATURES = 256 + N_KINDS**2 + TRIGRAMS + 2


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages (windows of PASSAGE bytes) of each text, and the first of each text.

    Shares of bytes, of pairs of byte kinds and of hashed trigrams, as square roots, and two lengths.
    An empty text is one empty passage.
    """
    data = [(t or "").encode() for t in texts]
    sizes = np.array([len(d) for d in data])
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(np.r_[0, counts])[:-1]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    starts = np.repeat(np.cumsum(np.r_[0, sizes])[:-1], sizes)
    at = np.repeat(first, sizes) + (np.arange(len(flat)) - starts) // PASSAGE
    n = int(counts.sum())

    def shares(kind: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        got = np.bincount(where * width + kind, minlength=n * width).reshape(n, width).astype(np.float32)
        return np.sqrt(got / np.maximum(1, got.sum(axis=1, keepdims=True)))

    kind = KINDS[flat]
    two, three = at[:-1] == at[1:], at[:-2] == at[2:]
    pair = (kind[:-1] * N_KINDS + kind[1:])[two]
    triple = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 2654435761 % 4294967291 % TRIGRAMS
    length = np.bincount(at, minlength=n) / PASSAGE
    return np.column_stack(
        [
            shares(flat, at, 256),
            shares(pair, at[:-1][two], N_KINDS**2),
            shares(triple[three], at[:-2][three], TRIGRAMS),
            length,
            np.repeat(np.log1p(sizes) / 10, counts),
        ]
    ).astype(np.float32), first


def in_steps(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The passages of some texts after the other, so that what they are made from stays small."""
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size < STEP_BYTES):
            size += len(texts[upto] or "")
            upto += 1
        yield passages(texts[at:upto])
        at = upto


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Passage codes, gated attention over each text's passages, score of the weighted code."""
    sizes = np.diff(np.r_[first, len(x)])
    x = x - m["mean"]
    h = np.tanh(x @ m["code"] + m["code0"])
    t, g = np.tanh(h @ m["view"]), sigmoid(h @ m["gate"])
    e = (t * g) @ m["weigh"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    a = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ m["out"] + m["out0"]), "sizes": sizes}


def gradients(m: dict, f: dict, y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    d = (f["p"] - y) / len(y)
    dz = np.repeat(d[:, None] * m["out"], f["sizes"], axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
    dtg = de[:, None] * m["weigh"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ m["view"].T + dg @ m["gate"].T) * (1 - f["h"] ** 2)
    return {
        "code": f["x"].T @ dh,
        "code0": dh.sum(axis=0),
        "view": f["h"].T @ dt,
        "gate": f["h"].T @ dg,
        "weigh": (f["t"] * f["g"]).T @ de,
        "out": f["z"].T @ d,
        "out0": d.sum(keepdims=True),
    }


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches of texts; equal input gives an equal model.

    Without both labels the model gives every text the share of label 1 (a half without labels).
    """
    rng = np.random.default_rng(seed)
    sizes = [max(1, -(-len((t or "").encode()) // PASSAGE)) for t in texts]
    x, first = np.empty((sum(sizes), N_FEATURES), np.float32), np.cumsum([0, *sizes])[:-1]
    n = 0
    for own, _ in in_steps(texts):
        x[n : n + len(own)] = own
        n += len(own)
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    m = {
        "mean": x.mean(axis=0) if len(x) else np.zeros(N_FEATURES, np.float32),
        "code": start(N_FEATURES, HIDDEN) * 4,
        "code0": np.zeros(HIDDEN, np.float32),
        "view": start(HIDDEN, GATE),
        "gate": start(HIDDEN, GATE),
        "weigh": start(GATE),
        "out": np.zeros(HIDDEN, np.float32),
        "out0": np.array([np.log(share / (1 - share))], np.float32),
    }
    if len(set(labels)) < 2:
        return m
    ends = np.r_[first[1:], len(x)]
    learned = [k for k in m if k != "mean"]
    mean, square = ({k: np.zeros_like(m[k], np.float64) for k in learned} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            own = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[k], ends[k]) for k in own])
            starts = np.cumsum(np.r_[0, (ends - first)[own]])[:-1]
            grads = gradients(m, forward(m, x[rows], starts), y[own], starts)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in learned:
                g = grads[k] + DECAY * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                m[k] = (m[k] - rate * move).astype(np.float32)
    return m


def _score(model: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = [forward(model, *step)["p"] for step in in_steps(texts)]
            p = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "_score"]
            )

    return score


def id_fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; a missing id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(text, label) of labelled documents outside fold 0: the first in a hash order, within both bounds.

    Texts over LARGEST of the bytes are passed over, so that none ends the sample early.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .groupBy("_id")
        .agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    )
    sizes = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_n"))
    first = (
        sizes.join(known, "_id")
        .filter((id_fold("_id") != 0) & (F.col("_n") <= sample_bytes * LARGEST))
        .withColumn("_h", F.xxhash64("_id", "_n"))
        .orderBy("_h", "_id", "_n")
        .limit(sample_docs)
    )
    total = F.sum("_n").over(Window.orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_sum", total).filter(F.col("_sum") <= sample_bytes).groupBy("_id", "_n").agg(
        F.max("_y").alias("_y")
    )
    # at most sample_docs rows
    return (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .withColumn("_n", F.octet_length("_text"))
        .join(F.broadcast(chosen), ["_id", "_n"])
        .select("_id", F.col("_text").alias("text"), F.col("_y").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "text")
        .limit(sample_docs)
        .select("text", "label")
    )


def quality_scores(
    docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out: str = "score"
) -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text (missing: empty) as ``out``."""
    columns = [c for c in docs.columns if c != out]
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != out)
    work = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("_text"))
    scored = work.mapInArrow(_score(model), f"{kinds}, _score double")
    return scored.withColumnRenamed("_score", out)


def quality_model(docs: DataFrame, labels: DataFrame, **options) -> dict[str, np.ndarray]:
    """The model fitted on the bounded sample; only texts and labels reach it.

    A sample of one label only is an error, as its model would keep or drop every text alike, and so
    is one without labels for want of short texts; without any labels all get a half, with a warning.
    """
    rows = training_sample(docs, labels, **options).collect()
    found = {r.label for r in rows}
    if len(found) == 1:
        raise ValueError(f"all {len(rows)} sampled documents have label {found.pop()}: both labels are needed")
    if not found:
        if training_sample(docs, labels, **{**options, "sample_bytes": 1 << 62}).limit(1).count():
            raise ValueError("all labelled documents are too long for the sample")
        warnings.warn("no labelled documents to learn from: every text scores a half", stacklevel=2)
    return fit([r.text for r in rows], [r.label for r in rows])


@query("op7_quality")
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf, "labels"))
    ids = docs.select("doc_id", (id_fold("doc_id") == 0).alias("held_out"), "text")
    scored = quality_scores(ids, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
