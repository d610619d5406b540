"""Lines repeated across documents: two Bloom filters, then an exact look at the suspects only."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import NO_ID, SPACE, query, rows_of, table, utf8

BITS = 1 << 27  # of each filter: 16 MB in a task and at most that on the driver
SEGMENT = 1 << 15  # bytes of a filter that travel as one row
HASHES = 2


def keys_of(lines: list[str], min_chars: int) -> list[bytes | None]:
    """Comparable form of each line; None for lines too short to be compared."""
    bare = [x.strip(SPACE) for x in lines]
    return [x.encode().lower() if len(x) >= min_chars else None for x in bare]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash: one row per hash function."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)])


def test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    hit = bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return hit.all(axis=0)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    if len(at):
        byte = at >> np.uint64(3)
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        mask = np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        bitmap[byte[first]] |= np.bitwise_or.reduceat(mask, first)


def _hashes(texts: list[str], min_chars: int) -> np.ndarray:
    """Hash of every distinct key of each text, text after text."""
    found: list[int] = []
    for text in texts:
        keys = {k for k in keys_of(text.split("\n"), min_chars) if k is not None}
        found += map(xxhash.xxh3_64_intdigest, keys)
    return np.array(found, dtype=np.uint64)


def _build(bits: int, min_chars: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(bits // 8, np.uint8) for _ in range(2))
        for batch in rows_of(batches):
            seen, n = np.unique(_hashes(utf8(batch.column(0)), min_chars), return_counts=True)
            at = places(seen, bits)
            put(twice, at[:, (n > 1) | test(once, at)])
            put(once, at)
        size = min(SEGMENT, bits // 8)
        for i in range(0, bits // 8, size):
            if once[i : i + size].any():
                parts = [[zlib.compress(x[i : i + size].tobytes(), 1)] for x in (once, twice)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // size], pa.int32()), *(pa.array(p, pa.binary()) for p in parts)],
                    ["segment", "once", "twice"],
                )

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments arrive in order; a bit set by two tasks has been seen twice."""
    now, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())],
            ["segment", "twice"],
        )

    for batch in batches:
        for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if segment != now:
                if now is not None:
                    yield out()
                now, once, twice = segment, a, b
            else:
                once, twice = once | a, twice | b | (once & a)
    if now is not None:
        yield out()


def repeated_filter(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """Bits of keys that at least two documents may hold: bits / 8 bytes, whatever the table."""
    made = texts.mapInArrow(_build(bits, min_chars), "segment int, once binary, twice binary")
    merged = (
        made.repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge, "segment int, twice binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT, bits // 8)
    for row in merged.collect():  # at most bits / 8 / SEGMENT rows
        bitmap[row.segment * size : (row.segment + 1) * size] = np.frombuffer(
            zlib.decompress(row.twice), np.uint8
        )
    return bitmap


def _suspects(shared, bits: int, min_chars: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in rows_of(batches):
            keys, ids = [], []
            for i, text in enumerate(utf8(batch.column(1))):
                own = {k for k in keys_of(text.split("\n"), min_chars) if k is not None}
                keys += own
                ids += [i] * len(own)
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
            hit = np.flatnonzero(test(bitmap, places(hashes, bits)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([ids[i] for i in hit], pa.int64())),
                    pa.array([digest(keys[i]) for i in hit], pa.binary()),
                ],
                ["_ld_id", "_ld_key"],
            )

    return probe


def _drop(text_at: int, drops_at: int, names: list[str], min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(
                batch.column(text_at).to_pylist(), batch.column(drops_at).to_pylist()
            ):
                lines = (text or "").split("\n")
                kept = lines
                if gone:
                    gone = set(gone)
                    keys = keys_of(lines, min_chars)
                    kept = [x for x, k in zip(lines, keys) if k is None or digest(k) not in gone]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(drops_at)]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*names, "n_lines", "n_dropped"],
            )

    return drop


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    bits: int = BITS,
) -> DataFrame:
    """Drop lines whose key is in ``min_docs`` documents, except in the largest id holding it.

    A line's key is the line without white space at its ends and with A-Z lower-cased; keys
    shorter than ``min_chars`` code points are never dropped. Returns the columns of ``docs`` with
    the text replaced, and ``n_lines`` (before) and ``n_dropped``; input columns of these two names
    are replaced.

    Every task fills a once-seen and a twice-seen filter over its documents; merging ORs them and
    adds the bits that two tasks set. Keys outside the twice-seen filter cannot repeat and never
    leave their task. Suspects travel as 16-byte digests, are counted exactly, and texts move once,
    to meet their drop lists. ``bits`` bounds the filters: more keys than it suits mean more
    suspects, never another result.

    Missing or empty texts are one empty line and come back as an empty text. Rows with the same
    id are one document, as are all rows without an id, which sort below every other. Empty tables
    give empty tables.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_ld_id")
    bitmap = repeated_filter(docs.select(text_col), bits, min_chars)
    shared = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
    suspects = materialise(
        docs.select(key, text_col).mapInArrow(
            _suspects(shared, bits, min_chars), "_ld_id long, _ld_key binary"
        ),
        "suspect_lines",
    )
    repeated = materialise(
        suspects.groupBy("_ld_key")
        .agg(F.count_distinct("_ld_id").alias("_ld_n"), F.max("_ld_id").alias("_ld_keeper"))
        .filter(F.col("_ld_n") >= min_docs)
        .select("_ld_key", "_ld_keeper"),
        "repeated_lines",
    )
    drops = (
        suspects.join(repeated, "_ld_key")
        .filter(F.col("_ld_id") != F.col("_ld_keeper"))
        .groupBy("_ld_id")
        .agg(F.collect_list("_ld_key").alias("_ld_drops"))
    )
    joined = docs.withColumn("_ld_id", key).join(drops, "_ld_id", "left")
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.select(*[F.col(f"`{c}`") for c in names], "_ld_drops").mapInArrow(
        _drop(names.index(text_col), len(names), names, min_chars),
        f"{kinds}, n_lines long, n_dropped long",
    )


LINES_SQL = r"""WITH l AS (
  SELECT doc_id, i, x AS line, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {docs})),
rep AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k
  HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, rep.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN rep USING (k)),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)"""


@query(
    "op2_line_dedup",
    LINES_SQL.format(docs="documents")
    + " SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM lines",
)
def op2(spark, sf):
    kept = line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
