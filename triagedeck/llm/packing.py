"""Best-fit packing: large pieces matched in pairs, small ones into the tightest gap."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import place
from ..session import materialise
from .base import query, rows_of, table, utf8
from .tokens import crc, encoder

CAPACITY = 4096
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, fill long"


def plan_sequences(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Where the pieces of each length go, from the number of pieces of each length.

    Rows (length, first rank, last rank, first sequence, pieces per sequence, fill): the pieces of
    that length with these ranks go, so many to a sequence, into successive sequences that hold
    ``fill`` tokens already. Pieces above a third of the capacity pair with the largest partner
    that fits; the others, the longest first, go to the sequences with the smallest gap that takes
    them. Equal pieces and equal sequences are handled together, so the work depends on the number
    of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    rows: list[tuple[int, ...]] = []
    gaps: list[int] = []  # ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    n_bins = 0

    def put(length: int, n: int, first: int, each: int, fill: int) -> None:
        rows.append((length, ranks[length], ranks[length] + n - 1, first, each, fill))
        ranks[length] += n
        left[length] -= n

    def opened(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1  # an odd piece goes with the next shorter one
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, n_bins, 1, 0)
        if b is not None:
            put(b, n, n_bins, 1, a)
        opened(capacity - a - (b or 0), n_bins, n)
        n_bins += n
        large = [x for x in large if left[x]]

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                each = capacity // s
                n = -(-left[s] // each)
                opened(capacity, n_bins, n)
                n_bins += n
                continue
            gap = gaps[at]
            first, n = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(at)
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            put(s, full * each, first, each, capacity - gap)
            opened(gap - each * s, first, full)
            opened(gap, first + full, n - full)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...).

    Lengths are from 1 to ``capacity``. Only the number of pieces of each length reaches the driver,
    at most ``capacity`` rows, and the plan made from it, which every task gets whole: its size
    depends on the number of lengths, not of pieces. A piece finds its place by its rank
    among those of its length; ranks are taken in buckets of a hash of the id, so a common length
    is not sorted in one task. Repeated rows get places of their own; an empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    plan = spark.createDataFrame(plan_sequences(counts, capacity), PLAN)
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sub = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sub.select(
        place(["length", "_b"]).alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = (
        keyed.withColumn("_at", place(["length", "_b"]))
        .join(offsets, "_at")
        .withColumn(
            "_rank", F.col("_off") + F.row_number().over(Window.partitionBy("_at").orderBy(*order)) - 1
        )
    )
    found = ranked.alias("p").join(
        F.broadcast(plan).alias("q"),
        (F.col("p.length") == F.col("q.length"))
        & F.col("p._rank").between(F.col("q.rank_from"), F.col("q.rank_to")),
    )
    nth = F.col("p._rank") - F.col("q.rank_from")
    return found.select(
        *[F.col(f"p.`{c}`") for c in pieces.columns],
        (F.col("q.first_sequence") + F.floor(nth / F.col("q.per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("q.fill") + nth % F.col("q.per_sequence") * F.col("p.length")).cast("long").alias("offset"),
    )


def _pieces(path: str, lower: bool, end_id: int, capacity: int):
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, lower).encode
        for batch in rows_of(batches):
            at, rows = [], []
            for i, text in enumerate(utf8(batch.column(1))):
                data = encode(text) + tail
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    at.append(i)
                    rows.append((piece, start, len(part) // 4, crc(part)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *columns],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    lower: bool = True,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text with ``end_id`` at its end, written once.

    ``doc_id``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` of the piece's ids. Only texts of more
    than ``capacity`` ids are cut. A missing text is empty: one piece with the end id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_pieces(tokenizer, lower, end_id, capacity), PIECES), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack: the pieces with their ``sequence_id`` and ``offset``."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity=capacity), capacity)


@query("op10_pack")
def op10(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
