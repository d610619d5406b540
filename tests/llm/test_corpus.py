"""Corpus operators against brute force, on rows with missing, empty, long, repeated and tied values."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from triagedeck.llm import fingerprints, line_dedup, mixing, near_dedup, packing, pii, quality, token_counts, token_files, tokens
from triagedeck.llm.embedding_dedup import near_vectors
from triagedeck.session import fresh_folder

SCHEMA = "doc_id long, text string, source string, n_lines int, _next int, score double"
SHARED = "A line that several documents share, word for word"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = {}
    for i in range(30):
        body = " ".join(rng.choice(words) for _ in range(40 + i))
        out[i] = body + ("\n  " + SHARED.upper() + "\t" if i % 3 == 0 else "\nshort") + "\nmail a.b%d@x.example.org now" % i
    out[30], out[31], out[32] = out[5], out[5] + " extra words", " ".join(rng.choice(words) for _ in range(9000))
    out[33], out[34], out[35], out[36] = None, "", " \t\n", "one two"
    return out


def rows():
    found = [(i, t, [None, "s0", "s0", "s1"][i % 4], 1, 2, 0.5) for i, t in texts().items()]
    return found + [found[3], (None, "a text without an id", "s1", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    key = {}
    for i, t, *_ in rows():
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(k) >= 20:
                key.setdefault(k, set()).add(-1 if i is None else i)
    want = []
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").lower() for x in lines]
        kept = [x for x, k in zip(lines, keys) if len(key.get(k, ())) < 3 or max(key[k]) == i]
        want.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    for bits in (1 << 10, 1 << 20):
        got = line_dedup.line_dedup(docs, bits=bits)
        assert got.columns == ["doc_id", "text", "source", "_next", "score", "n_lines", "n_dropped"]
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(want)
    assert line_dedup.line_dedup(none, bits=1 << 10).count() == 0


def test_mix_meets_targets(spark, docs, none):
    mix = mixing.mix_sources(docs).collect()
    size = {}
    for _, t, s, *_ in rows():
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1)))
    target, left, total = {}, set(order), float(sum(size.values()))
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] if over else level * weight[s] for s in over or left}
        left -= over or left
    taken = {}
    for r in mix:
        assert 0 <= r.taken <= 3 * r.size and math.isclose(r.target, target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and len(mix) == len(rows())
    mixed = mixing.repeat_documents(docs, mixing.mix_sources(docs))
    assert mixed.columns == docs.columns
    assert mixed.select(mixing.n_words(mixed["text"]).alias("n")).groupBy().sum("n").first()[0] == sum(taken.values())
    assert mixing.mix_sources(none).count() == 0


def links_of(sets):
    ids = list(sets)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates(docs, none):
    sets = {}
    for i, t in texts().items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    want = links_of(sets)
    for r in near_dedup.near_duplicates(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketch_parts():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[200:2200]
    regs = near_dedup.registers([a, b, np.union1d(a, b)], 1024)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    n = np.array([2000.0])
    assert abs(near_dedup.likelihood_similarity(regs[:1], regs[1:2], n, n)[0] - 1800 / 2200) < 0.06
    sets = [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(9)]
    got = near_dedup.shared_counts(sets, 4, columns=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(9) if i != j)


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    bitmap = near_dedup.id_filter(ids, 1 << 20)
    held = near_dedup.test(bitmap, near_dedup._id_places(np.arange(3000), 1 << 20))
    assert held[::3].all() and held.sum() < 1100
    shared = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
    told = spark.range(3000).selectExpr("id", "concat('word ', id) AS text")
    sets = told.mapInArrow(near_dedup._sets(5, shared), "k1 long, k2 long, items binary").collect()
    want = {near_dedup.shingles(f"word {i}", 5).tobytes() for i in np.flatnonzero(held)}
    assert {bytes(r.items) for r in sets} == want and len(sets) == held.sum()
    assert all((r.k1, r.k2) == near_dedup.set_key(np.frombuffer(r.items, np.uint64)) for r in sets)
    assert not near_dedup.id_filter(ids.limit(0), 1 << 20).any()


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    v = [(i, (base[i % 12] + rng.normal(size=8) * 0.25 * (i % 3)).astype(np.float32).tolist(), 1) for i in range(60)]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0]]
    v += [(100 + i, x, None) for i, x in enumerate(odd)] + [(200, v[0][1], 3), v[1]]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<float>, n_links int")
    x = np.array([r[1] for r in v[:60] + v[67:]], np.float64)
    ids = np.array([r[0] for r in v[:60] + v[67:]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    low = ids.copy()
    for _ in ids:
        low = np.array([low[n].min() for n in near])
    want = sorted([(int(i), int(n.sum()) - 1, int(c)) for i, n, c in zip(ids, near, low)] + [(100 + i, 0, 100 + i) for i in range(7)])
    for block in (7, 4096):
        got = near_vectors(frame, block_rows=block)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert near_vectors(frame.limit(0)).count() == 0


def test_fingerprints(docs, none):
    known = sorted(((i, t or "") for i, t, *_ in rows() if i is not None), reverse=True)
    known.append((None, "a text without an id"))
    want = []
    for k, (i, t) in enumerate(known):
        n = len(t) // 3
        edited = t[: len(t) - n] + known[(k + 1) % len(known)][1][:n]
        want.append((str(i), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.next_edits(docs).collect()
    assert sorted((str(r.doc_id), hashlib.sha256(r.edited.encode()).hexdigest()) for r in got) == sorted(want)
    by = {r.doc_id: r.hashes for r in got}
    assert by[5] == by[30] and by[34] == [] and len(by[36]) == 1
    assert fingerprints.next_edits(none).count() == 0


def test_token_operators(spark, docs, none):
    word, byte = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    lib = Tokenizer.from_file(word)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in texts().items()}
    cache = fresh_folder(spark, "test_cache")
    for _ in range(2):  # the second time everything is known
        for r in token_counts.token_counts(docs, word, cache).collect():
            if r.doc_id is not None:
                assert (r.n_tokens, r.over_limit) == (len(want[r.doc_id]), len(want[r.doc_id]) > 2048)
    assert spark.read.parquet(cache).count() == len({re.sub(r"\s+", " ", r[1] or "").lower() for r in rows()})
    lib2 = Tokenizer.from_file(byte)
    folder = fresh_folder(spark, "test_files")
    token_files.write_token_files(docs, folder, byte, 2, segment=300)
    start = 0
    for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = lib2.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
    placed = packing.pack_documents(docs, word).collect()
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            ids = np.array((want[r.doc_id] + [1])[r.start : r.start + r.length], "<u4")
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 4096
    assert packing.pack_documents(none, word).count() == 0
    assert token_counts.token_counts(none, word, fresh_folder(spark, "test_cache")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_as_tight_as_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(500)]
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= n]
        at = min(fits, key=lambda i: bins[i]) if fits else len(bins)
        bins[at:] = [bins[at] - n, *bins[at + 1 :]] if fits else [100 - n]
    plan = packing.plan_sequences({n: lengths.count(n) for n in set(lengths)}, 100)
    used = {}
    for length, low, high, first, each, fill in plan:
        for k in range(high - low + 1):
            used.setdefault(first + k // each, []).append((fill + k % each * length, length))
    assert sum(map(len, used.values())) == len(lengths) and len(used) <= len(bins) + 1
    for b in used.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 100


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 50_000, 9000), np.full(5, 7), np.r_[np.zeros(90), 2**32 - 1], np.zeros(0)):
        ids = ids.astype(np.uint32)
        assert (token_files.unpack_segment(token_files.pack_segment(ids, 1000)) == ids).all()


@pytest.mark.parametrize("lower, name", [(True, "word_bpe_49k.json"), (False, "byte_bpe_50k.json")])
def test_encoder_equals_the_library(lower, name):
    e = tokens.WordEncoder(public_tokenizers.path(name), lower, max_words=50)
    odd = ["it's  'S we'LL\t\n x", "é É é ß İ Σς", "中文 жук 12³½", "a<|endoftext|>b", "\x00\x85  z", " \n \n  a  ", "👍🏽!!"]
    rng = random.Random(5)
    odd += ["".join(rng.choice("aé'S19 \n.,ßя中́") for _ in range(60)) for _ in range(200)]
    for t in odd:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_pii(docs, none):
    card = "4111 1111 1111 1111"
    text = f"x.y@a-b.co.uk.,@c.d 1.2.3.4.5.6.7.8 256.1.1.1, {card}, 4111111111111112, +1 (555) 010-9999 é+12"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "x.y@a-b.co.uk"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", card), ("phone", "+1 (555) 010-9999")
    ]
    for long in ("a" * 200_000, "1" * 200_000, "+" + "(" * 200_000, "a@" * 50_000):
        assert pii.base_spans(long) == []
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 6))
    x[:, 0] = 0
    y = (x[:, 1] * x[:, 2] > 0).astype(int)
    model = pii.fit(x, y, 0.8)
    assert ((pii.chance(model, x) > 0.5) == y).mean() > 0.9
    found = pii.find_pii(docs, pii.pii_model(docs)).collect()
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id is not None:
            assert r.n_email == (texts()[r.doc_id] or "").count("@")
    assert pii.pii_model(none) is None and pii.find_pii(none, None).count() == 0


def test_quality(spark, docs, none):
    good = [f"plain words about thing {i} and more of the same\n" * (1 + i % 5) for i in range(80)]
    bad = [f"w{i}### $$$ x%%% &&& y***" * (1 + i % 4) for i in range(80)]
    model = quality.fit(good[:60] + bad[:60], [1] * 60 + [0] * 60)
    p = quality.forward(model, *quality.passages(good[60:] + bad[60:] + [""]))["p"]
    assert (p[:20] > 0.5).all() and (p[20:40] < 0.3).all()
    empty = quality.quality_model(none, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.quality_scores(docs, empty).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)


def test_gradients_agree_with_differences():
    x, first = quality.passages(["a b c" * 300, "d" * 700, ""])
    m = quality.fit([], [])
    m = {k: v.astype(np.float64) for k, v in m.items()}
    m["out"] = np.random.default_rng(0).normal(size=quality.HIDDEN)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality.forward(m, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality.gradients(m, quality.forward(m, x, first), y, first)
    for name in ("code", "view", "gate", "weigh", "out"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), m[name].shape)
        m[name][at] += 1e-5
        high = loss()
        m[name][at] -= 2e-5
        assert math.isclose((high - loss()) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-7)
        m[name][at] += 1e-5


def pipeline_folder(spark, docs, labels):
    folder = fresh_folder(spark, "test_sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages(spark, docs):
    folder = pipeline_folder(spark, docs.select("doc_id", "text", "source"), [(i, int(i % 3 > 0), 0) for i in range(30)])
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == ["doc_id", "text", "source"], name
    assert corpus_pipeline.run(spark, folder).filter("length > 4096").count() == 0


def test_pipeline_needs_both_labels(spark, docs):
    folder = pipeline_folder(spark, docs.select("doc_id", "text", "source"), [(i, 1, 0) for i in range(30)])
    with pytest.raises(ValueError, match="label 1"):
        corpus_pipeline.run(spark, folder)


CLASHES = ["_score", "_text", "_quality", "quality", "_ld_id", "_ld_drops", "n_lines", "n_dropped", "_mix", "_at", "_own", "_nth", "rest", "pos", "_none_", "n_chars", "_salt"]


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    extra = docs.select("doc_id", "text", "source", *[F.concat(F.lit(c + " of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES if c != "n_chars"], F.lit(-1).cast("long").alias("n_chars"))
    folder = pipeline_folder(spark, extra, [(i, int(i % 3 > 0), 0) for i in range(30)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert got.dtypes == extra.dtypes, name
        for r in got.limit(5).collect():
            for c in CLASHES:
                if c != "n_chars" and r.doc_id is not None:
                    assert r[c] == f"{c} of {r.doc_id}", (name, c)


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    body = " ".join(f"w{i}" for i in range(50))
    told = [(1, body), (1, body), (2, body), (None, body), (3, "other words entirely here now"), (3, body + " more"), (4, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in told], "doc_id long, text string, source string")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, body), (3, "other words entirely here now"), (4, "")]


def test_odd_pieces_pair_with_the_next_length():
    lengths = range(1400, 2000, 10)
    plan = packing.plan_sequences({n: 1 for n in lengths}, 4096)
    assert max(first + -(-(hi - lo + 1) // each) for _, lo, hi, first, each, _ in plan) == 30
    fill = Counter()
    for length, lo, hi, first, each, _ in plan:
        for k in range(hi - lo + 1):
            fill[first + k // each] += length
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= 4096
