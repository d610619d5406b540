"""Near-duplicate texts: SetSketch registers, banded, estimated by likelihood, verified on full sets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import NO_ID, query, rows_of, table
from .components import components
from .embedding_dedup import join_labels
from .line_dedup import SEGMENT, places, put, test

REGISTERS = 128
BAND = 4  # registers in a band: at a similarity of 0.8 a link shares none of 32 bands once in 2e7
BASE = 1.001  # registers are spaced by this factor
RATE = 20.0  # of the exponential hash values
TOP = (1 << 16) - 1  # registers are cut to 0 .. TOP
LIKELY = 0.18  # estimates this far below the threshold are still verified: five standard errors
TILE_ROWS = 512  # sets in a block; a tile holds two blocks
TILE_BYTES = 8 << 20  # of a block's sets
COLUMNS = 4096  # shared shingles of a tile that are counted at once
FILTER_BITS = 1 << 27  # of the filter of wanted ids: 16 MB in a task and at most that on the driver
MAX_WORDS = 200_000  # entries of a task's table of word hashes before it starts anew: about 40 MB

_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """One odd multiplier per register."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    try:
        got = [_words[w] for w in words]
    except KeyError:
        if len(_words) > MAX_WORDS:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        got = [_words[w] for w in words]
    return np.array(got, dtype=np.uint64)


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(n_words, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(s))


def registers(sets: list[np.ndarray], n: int = REGISTERS) -> np.ndarray:
    """Registers of each (non-empty) set: floor(1 - log of its smallest hash value), cut to 0 .. TOP.

    Hash values are exponential; the smallest comes from the smallest uniform one, so the
    logarithm is taken once per register. The maximum of two registers is that of the union.
    """
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    low = np.stack([np.minimum.reduceat(flat * m, starts) for m in multipliers(n)], axis=1)
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint16)


def set_key(s: np.ndarray) -> tuple[int, int]:
    data = s.tobytes()
    return tuple(xxhash.xxh3_64_intdigest(data, seed=i) - (1 << 63) for i in (1, 2))


def likelihood_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers (row by row) and set sizes.

    Counts of registers that are larger, smaller and equal have known probabilities given the
    similarity; their log-likelihood is concave and maximised by golden sections.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    step = (BASE - 1) / BASE

    def share(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * step) / math.log(BASE)

    def fit(j):
        up, down = share(u - v * j), share(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = fit(x) >= fit(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _sketch(n_words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            sets = [shingles(x, n_words) for x in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            regs = iter(registers(full).astype("<u2")) if full else iter(())
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "regs"],
            )

    return sketch


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit bucket of each band of each row."""
    parts = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(BAND):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 4096):
        keys = band_keys(_regs(batch.column(1)))
        cls = np.repeat(np.asarray(batch.column(0), np.int64), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(cls)], ["bucket", "cls"])


def _likely(cut: float):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 8192):
            n_a, n_b = (np.asarray(batch.column(i), np.float64) for i in (2, 3))
            j = likelihood_similarity(_regs(batch.column(4)), _regs(batch.column(5)), n_a, n_b)
            yield batch.select([0, 1]).filter(pa.array(j >= cut))

    return likely


def shared_counts(items: list[np.ndarray], n_first: int, columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of the first n_first sets with each of all sets."""
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, item, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    common = times[item] > 1
    row, item = row[common], item[common]
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    item = np.cumsum(np.r_[0, item[1:] != item[:-1]]) if len(item) else item
    counts = np.zeros((n_first, len(items)), np.float64)
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, columns):
        low, high = np.searchsorted(item, [at, at + columns])
        held = np.zeros((len(items), columns), np.float32)
        held[row[low:high], item[low:high] - at] = 1
        counts += held[:n_first] @ held.T
    return counts


def _tile(percent: int):
    """Links between two blocks of a neighbourhood: each set with the first one it connects to."""

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("second", "ascending"), ("cls", "ascending")])
        cls = np.asarray(rows["cls"].combine_chunks(), np.int64)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"].combine_chunks()]
        n = np.array([len(x) for x in items], np.float64)
        n_first = len(cls) - int(np.asarray(rows["second"].combine_chunks()).sum())
        both = shared_counts(items, n_first)
        i, j = np.nonzero(100 * both >= percent * (n[:n_first, None] + n[None, :] - both))
        label = join_labels(np.arange(len(cls)), i, j)
        joined = np.flatnonzero(label != np.arange(len(cls)))
        return pa.table({"a": pa.array(cls[joined]), "b": pa.array(cls[label[joined]])})

    return tile


def _sets(n_words: int, shared):
    """Keys and full set of each text whose id the filter may hold."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NO_ID), np.int64)
            near = batch.column(1).filter(pa.array(test(bitmap, _id_places(ids, 8 * len(bitmap))).astype(bool)))
            for at in range(0, len(near), 256):
                found = [s for s in (shingles(x, n_words) for x in near.slice(at, 256).to_pylist()) if len(s)]
                keys = [set_key(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    ["k1", "k2", "items"],
                )

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1024):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    return confirm


def _id_places(ids: np.ndarray, bits: int) -> np.ndarray:
    return places(mixed(np.asarray(ids, np.int64).view(np.uint64)), bits)


def _build_ids(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(bitmap, _id_places(batch.column(0), bits))
        size = min(SEGMENT, bits // 8)
        for i in range(0, bits // 8, size):
            if bitmap[i : i + size].any():
                part = zlib.compress(bitmap[i : i + size].tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // size], pa.int32()), pa.array([part], pa.binary())], ["segment", "bits"]
                )

    return build


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments arrive in order; each leaves once, with the bits of all tasks."""

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())],
            ["segment", "bits"],
        )

    now, held = None, None
    for batch in batches:
        for segment, part in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(zlib.decompress(part), np.uint8)
            if segment == now:
                held = held | part
                continue
            if now is not None:
                yield out()
            now, held = segment, part
    if now is not None:
        yield out()


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of the ids: bits / 8 bytes, whatever their number."""
    merged = (
        ids.mapInArrow(_build_ids(bits), "segment int, bits binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_unite, "segment int, bits binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT, bits // 8)
    for row in merged.collect():  # at most bits / 8 / SEGMENT rows
        bitmap[row.segment * size : (row.segment + 1) * size] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return bitmap


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, n_words: int) -> DataFrame:
    """(cls, items): the full set of each wanted class, from one of its texts.

    Tasks make the sets of texts whose id a filter of the wanted ids may hold; only these sets are
    shuffled, and the join by their keys decides. More ids than the filter suits mean more sets in
    the shuffle, never another result.
    """
    reps = materialise(classes.select("cls", "rep", "k1", "k2").join(wanted, "cls"), "wanted_sets")
    bitmap = id_filter(reps.select(F.coalesce("rep", F.lit(NO_ID))))
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
    found = docs.mapInArrow(_sets(n_words, shared), "k1 long, k2 long, items binary")
    return materialise(
        found.join(reps.select("k1", "k2", "cls"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("cls", "items"),
        "sets",
    )


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    confirmed = checked.mapInArrow(_confirm(percent), "a long, b long, linked boolean")
    return materialise(confirmed.filter("linked").select("a", "b"), "verified")


def _rest(
    members: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, n_words: int, percent: int
) -> DataFrame:
    """Links among the classes of buckets that are not connected yet, by full sets in tiles.

    Such classes that share buckets, directly or through others, are a neighbourhood. Within it,
    sets whose sizes allow a link meet in tiles of two blocks.
    """
    placed = members.join(roots, F.col("cls") == F.col("node"), "left").select(
        "bucket", "first", "cls", F.coalesce("root", "cls").alias("comp")
    )
    placed = materialise(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    split = materialise(split.filter("_low < _high").select("bucket"), "unconnected")
    near = placed.join(split, "bucket").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    groups = materialise(components(near), "neighbourhoods")
    sets = _full_sets(groups.select(F.col("node").alias("cls")), docs, classes, n_words)
    n = F.octet_length("items") / 8
    band = F.floor(F.log(n) / math.log(100 / percent)).cast("int")
    sized = materialise(
        sets.join(groups, F.col("cls") == F.col("node")).select(
            "root", F.explode(F.array(band, band - 1)).alias("band"), "cls", "items"
        ),
        "sized_sets",
    )
    fill = F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum(F.octet_length("items")) / TILE_BYTES)
    blocks = sized.groupBy("root", "band").agg(F.ceil(fill).cast("int").alias("_blocks"))
    tiles = (
        sized.join(materialise(blocks, "blocks"), ["root", "band"])
        .withColumn("_own", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "root",
            "band",
            F.least("_own", "_other").alias("low"),
            F.greatest("_own", "_other").alias("high"),
            (F.col("_other") < F.col("_own")).alias("second"),
            "cls",
            "items",
        )
    )
    return tiles.groupBy("root", "band", "low", "high").applyInArrow(_tile(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of each row.

    Texts are sets of ``n_words`` shingles of their words (A-Z lower-cased); two link when
    their Jaccard similarity is at least ``percent`` / 100. Texts with equal sets are one class. Its
    registers are cut into bands, and classes that share a band may link:

    1. Each class of a bucket is paired with the bucket's first. Pairs whose likelihood estimate
       is near the threshold or above are verified on the full sets.
    2. Where a bucket still holds unconnected classes, these and all that share such a bucket with
       them are compared by their full sets, in tiles of two bounded blocks.

    A pair within one component needs no link of its own, so every pair that shares a band is
    settled. A tile returns at most one row per set, so no group returns its pairs.

    Texts without words, missing ones included, have no shingles and link with nothing. ``component_id`` is the
    smallest id reachable, missing only where all of them are. Repeated rows and rows that share
    an id are vertices of their own. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(
        docs.mapInArrow(_sketch(n_words), "doc_id long, n_shingles long, k1 long, k2 long, regs binary"),
        "sketches",
    )
    full = sketched.filter("n_shingles > 0")
    classes = materialise(
        full.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "text_classes",
    )
    bands = classes.select("cls", "regs").mapInArrow(_bands, "bucket long, cls long")
    shared = bands.groupBy("bucket").agg(F.min("cls").alias("first"), F.max("cls").alias("_last"))
    shared = materialise(shared.filter(F.col("first") < F.col("_last")).select("bucket", "first"), "buckets")
    members = materialise(bands.join(shared, "bucket"), "bucket_members")
    cut = percent / 100 - LIKELY
    sizes = classes.select("cls", "n_shingles", "regs")

    def renamed(side: str) -> DataFrame:
        return sizes.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("regs").alias(f"r_{side}"))

    stars = members.filter("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    likely = materialise(
        stars.join(renamed("a"), "a")
        .join(renamed("b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", "n_a", "n_b", "r_a", "r_b")
        .mapInArrow(_likely(cut), "a long, b long"),
        "likely_pairs",
    )
    wanted = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    roots = components(_verify(likely, _full_sets(wanted, docs, classes, n_words), percent))
    rest = _rest(members, roots, docs, classes, n_words, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    known = materialise(
        classes.select("k1", "k2", "cls", "rep")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .select("k1", "k2", "rep", F.coalesce("root", "cls").alias("root")),
        "class_roots",
    )
    lowest = materialise(known.groupBy("root").agg(F.min("rep").alias("low")), "class_lowest")
    found = materialise(known.join(lowest, "root").select("k1", "k2", "low"), "class_components")
    component = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return (
        sketched.select("doc_id", "n_shingles", "k1", "k2")
        .join(found, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )
    )


NEAR_SQL = r"""{p}w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
{p}s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS s FROM {p}w),
{p}n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM {p}s GROUP BY doc_id),
{p}link AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM {p}s p JOIN {p}s q
      ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
    JOIN {p}n na ON na.doc_id = a JOIN {p}n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{p}reach AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT r.a, l.b FROM {p}reach r JOIN {p}link l ON r.b = l.a),
{p}near AS MATERIALIZED (SELECT {p}reach.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
  FROM {p}reach LEFT JOIN {p}n ON {p}n.doc_id = {p}reach.a GROUP BY {p}reach.a)"""


@query(
    "op4_near_dedup",
    "WITH RECURSIVE "
    + NEAR_SQL.format(p="", docs="documents", n=4)
    + " SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
)
def op4(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), n_words=4)
