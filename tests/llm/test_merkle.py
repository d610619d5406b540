"""Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from triagedeck.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int, grp int, idx string, n int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n, *_ = row
    values = [None if v is None else str(v) for v in (i, source, lang, n, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes, at, changed):
    """Top of the nodes, siblings of the one at ``at``, and the top with ``changed`` in its place."""
    proof = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        run, j = runs[at // 8], at % 8
        proof += run[:j] + run[j + 1 :]
        changed = sha("".join(run[:j] + [changed] + run[j + 1 :]))
        nodes, at = [sha("".join(r)) for r in runs], at // 8
    return nodes[0], proof, changed


def rows():
    extra = ("x", 1, 2, "y", 3)
    out = [(i * 7, f"Text {i} Ä\nEnd", "en", "s%d" % (i % 3), i, *extra) for i in range(600)]
    out += [(100000 + i, "B" * i, "fr", None, None, *extra) for i in range(9)]
    out += [(200000 + i, None, None, "", i, *extra) for i in range(70)]
    out += [(300000, "Only ONE", "zz", "s", 8, *extra), (300003, "long " * 40000, "", "s", 8, *extra)]
    return out + [out[3], out[3], (None, "No id", "fr", "s", 1, *extra)]


def lowered():
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    return {"text": F.when(hit, F.lower("text")).otherwise(F.col("text"))}


def expected():
    groups = {}
    for r in rows():
        i, t, lang, *_ = r
        hit = zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 0
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(r, t), leaf(r, t.lower() if hit and t else t)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])], 0, "")[0] for g in langs}
    out = []
    for at, g in enumerate(langs):
        nodes = sorted(groups[g])
        for j, (known, i, d, c) in enumerate(nodes):
            top, low, mid = climb([x[2] for x in nodes], j, c)
            root, high, end = climb([tops[x] for x in langs], at, mid)
            out.append((str(i if known else None), d, top, root, sha("".join(low + high)), end, end == root))
    return sorted(out)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_proofs(spark, every):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    got = merkle.merkle_proofs(docs, tampered=lowered(), every=every)
    proof = F.sha2(merkle.proof_text("path"), 256)
    got = got.select(F.col("doc_id").cast("string"), "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected()


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.merkle_proofs(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.path == [] and r.verified
    assert merkle.merkle_proofs(one.limit(0)).count() == 0


def test_only_every_few_levels_are_stored(spark):
    nodes = spark.range(600).selectExpr("'g' AS grp", "id AS idx", "600L AS n", "sha2(string(id), 256) AS digest")
    kept = merkle.build(nodes, 8, 2).levels
    assert [x.count() for x in kept] == [600, 10, 1]


def test_crc_in_sql():
    for text in ("0", "17", "123456789", "-5:12", ""):
        assert duckdb.sql(f"SELECT {merkle.crc_sql(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())
