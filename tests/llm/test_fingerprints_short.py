"""Likeness of short texts, against sets of their shingles."""

import random

import pytest
from pyspark.sql import functions as F

from triagedeck.llm import fingerprints as fp


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def errors(spark, lengths, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=n)) for n in lengths]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = fp.next_edits(docs)
    got = d.select(
        "text", "edited", F.size("hashes").alias("kept"),
        fp.resemblance(d.hashes, d.edited_hashes).alias("near"),
        fp.containment(d.hashes, d.edited_hashes).alias("held"),
    ).collect()
    assert len(got) == len(texts)
    near = held = kept = whole = 0.0
    for r in got:
        a, b = shingles(r.text), shingles(r.edited)
        near += (r.near - len(a & b) / len(a | b)) ** 2 / len(got)
        held += (r.held - len(a & b) / len(a)) ** 2 / len(got)
        kept, whole = kept + r.kept, whole + len(a)
    return near**0.5, held**0.5, kept / whole


@pytest.mark.parametrize("low, high, bound", [(10, 30, 0.2), (30, 60, 0.12), (60, 150, 0.09), (300, 400, 0.05)])
def test_likeness_errs_within_its_bound(spark, low, high, bound):
    near, held, kept = errors(spark, [low + i % (high - low) for i in range(150)], low)
    assert near < bound and held < bound and 0.44 < kept < 0.6


def test_fingerprints_merge(spark):
    """The sketch of a union follows from the sketches of its parts."""
    a, b = "one two three four five six seven eight", "seven eight nine ten eleven twelve thirteen"
    row = spark.range(1).select(fp.fingerprint(F.lit(a)).alias("a"), fp.fingerprint(F.lit(b)).alias("b"), fp.shingle_hashes(F.lit(a)).alias("x"), fp.shingle_hashes(F.lit(b)).alias("y")).first()
    whole = set(row.x) | set(row.y)
    assert {h for h in (*row.a, *row.b) if h < 0} == {h for h in whole if h < 0}


@pytest.mark.parametrize("n_ids", [0, 3, 200])
def test_next_rows_of_many_without_an_id(spark, n_ids):
    """One circle through all rows: by descending id, then the rows without one by the hash of their text."""
    rows = [(i * 7, f"text of {i}") for i in range(n_ids)] + [(None, f"no id {i % 250}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    texts = [r.text for r in docs.orderBy(*order).collect()]
    paired = fp.with_next(docs, "doc_id", ["text"], ["text"])
    assert paired.columns == ["doc_id", "text", "_next"]
    got = sorted((r.text, r._next.text) for r in paired.collect())
    assert got == sorted(zip(texts, texts[1:] + texts[:1]))
