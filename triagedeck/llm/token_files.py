"""Token ids in files of patched frame-of-reference blocks, in document order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_folder
from .base import query, table, utf8
from .tokens import encoder

BLOCK = 4096  # ids that share a minimum and a width
SEGMENT = 1 << 17  # ids after which a segment ends with its document
PERCENTILE = 90  # share of a block's ids whose width is packed; the rest are exceptions
HEAD = "<IBHH"  # minimum, width, ids, exceptions


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Minimum, width, counts; then the packed low bits; then exception places and values."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, at)[at]).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = rest.copy()
    kept[out] = 0
    bits = (kept[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return (
        struct.pack(HEAD, low, width, len(ids), len(out))
        + packed
        + out.astype("<u2").tobytes()
        + rest[out].astype("<u4").tobytes()
    )


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    low, width, n, n_out = struct.unpack_from(HEAD, data, at)
    at += struct.calcsize(HEAD)
    size = -(-n * width // 8)
    bits = np.unpackbits(
        np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little"
    ).reshape(n, width)
    rest = np.zeros(n, np.uint32)
    for i in range(width):
        rest |= bits[:, i].astype(np.uint32) << np.uint32(i)
    at += size
    if n_out:
        out = np.frombuffer(data, "<u2", n_out, at)
        rest[out] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return rest + np.uint32(low)


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Number of blocks, the place of each block, the blocks."""
    blocks = [pack_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    starts = np.cumsum([4 + 4 * len(blocks), *map(len, blocks)])[:-1].astype("<u4")
    return struct.pack("<I", len(blocks)) + starts.tobytes() + b"".join(blocks)


def unpack_segment(data: bytes) -> np.ndarray:
    view = memoryview(data)
    (n,) = struct.unpack_from("<I", view, 0)
    starts = np.frombuffer(view, "<u4", n, 4)
    return np.concatenate([unpack_block(view, int(s)) for s in starts] or [np.empty(0, np.uint32)])


SEGMENTS = "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def _write(path: str, lower: bool, end_id: int, segment: int):
    tail = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, lower).encode
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, n = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            values = [[part], [seq], [before], [n], [doc_ids], [lengths], [pack_segment(ids)]]
            kinds = [
                *(pa.int32(), pa.int32(), pa.int64(), pa.int64()),
                *(pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                ["part", "seq", "before", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                data = encode(text) + tail
                doc_ids.append(doc_id)
                lengths.append(len(data) // 4)
                held.append(data)
                n += len(data) // 4
                if n >= segment:
                    yield row()
                    seq, before = seq + 1, before + n
                    doc_ids, lengths, held, n = [], [], [], 0
        if doc_ids:
            yield row()

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    lower: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> None:
    """Encode every text, append ``end_id``, and write the ids by ascending id.

    The rows are dealt out by ranges of the id, so a text moves once. A segment holds whole
    documents and at least ``segment`` ids (the last of a task fewer): blocks of ``BLOCK`` ids with
    their starts, beside the ids and lengths of its documents and the number of ids ``before`` it in its
    part. Segments are ordered by ``part`` and ``seq``; ``folder``/parts has the ids before each part.

    Missing texts are empty: the end id alone. Rows without an id come first; rows with the same
    id follow each other by text. Every row is written.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(_write(tokenizer, lower, end_id, segment), SEGMENTS).write.parquet(
        f"{folder}/segments"
    )
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per writing task
    sizes.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")).write.parquet(
        f"{folder}/parts"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, doc_ids, lengths, payload = (c[i].as_py() for c in batch.columns)
            data = unpack_segment(payload).astype("<u4").tobytes()
            ends = np.cumsum(lengths, dtype=np.int64)
            begins = ends - np.asarray(lengths, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begins + start),
                    pa.array(ends - begins),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(begins, ends)], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian 32-bit) per document.

    Segments are decoded where they are read. The table of parts has one row per task that wrote,
    at most as many as the shuffle partitions of that job, so every reader gets it whole.
    """
    segments = spark.read.parquet(f"{folder}/segments")
    parts = spark.read.parquet(f"{folder}/parts")
    return (
        segments.join(F.broadcast(parts), "part")
        .select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
        .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
    )


@query("op8_token_files")
def op8(spark, sf):
    import public_tokenizers

    folder = fresh_folder(spark, "token_files")
    write_token_files(
        table(spark, sf, "documents").select("doc_id", "text"),
        folder,
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
    )
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
