"""Scores of texts by context-tree weighting, learned from the training documents.

A text is its tokens in order: words with ASCII letters lower-cased, a space after each, then an end byte. Each byte is
eight binary choices. A choice is predicted in the contexts of the last 0 to D bytes; in each, a
Krichevsky-Trofimov estimate counts what followed, and the weighted mixture over all depths is that of the
context tree: half of every node's probability is its own estimate, half the product of its children's.
"""

from __future__ import annotations

import ctypes
import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release
from .base import query, rows_of, table

DEPTH = 5  # bytes of the longest context; at most 6, so that a context, its byte and its bit fit a long
END = b"\n"
PIECE_BYTES = 1 << 20  # a longer text is cut behind the next space
CHUNK_BYTES = 1 << 18  # pieces compressed together
BLOCK_BYTES = 1 << 26  # texts whose contexts are asked for together
UNIQUE_BYTES = 1 << 20  # bytes whose contexts are sorted at a time
WORD_BYTES = 1 << 22  # bytes whose words are numbered at a time
LOOKUP_BYTES = 1 << 23  # bytes whose words are looked up at a time
ALPHA = 0.1
LOG_PI = math.log(math.pi)

CHUNKS = "block long, row array<long>, doc_id array<long>, train array<boolean>, size array<long>, body binary"
PARTS = "row long, doc_id long, train boolean, n_tokens long, n_known long, n_bytes long, base double, bits double, n_new long"


def _give_back() -> None:
    """Free memory goes back to the system: a worker that waits for its next task keeps it beside the JVM otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def _lean(step):
    """A step over batches that gives its memory back at the end of a task."""

    @functools.wraps(step)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _give_back()

    return lean


def token_bytes(text: str | None) -> bytes:
    """Words, a space behind each, and the end. ``bytes.split`` knows the same white space as the words' pattern."""
    words = (text or "").encode().lower().split()
    return b" ".join([*words, END])


def _cut(depth: int, piece_bytes: int, block_bytes: int):
    """Documents -> pieces with the bytes before them, compressed in chunks and numbered by block."""

    def chunk(block: int, held: list[tuple]) -> pa.RecordBatch:
        row, doc, train, parts = zip(*held)
        body = zstandard.ZstdCompressor(level=6).compress(b"".join(parts))
        kinds = {"row": (row, pa.int64()), "doc_id": (doc, pa.int64()), "train": (train, pa.bool_())}
        kinds["size"] = ([len(x) for x in parts], pa.int64())
        lists = [pa.array([list(v)], pa.list_(k)) for v, k in kinds.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), *lists, pa.array([body], pa.binary())], ["block", *kinds, "body"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        block, row, held, size, in_block = first, first, [], 0, 0
        for batch in rows_of(batches, 256):
            for doc, train, text in zip(*(c.to_pylist() for c in batch.columns)):
                whole = token_bytes(text)
                at = 0
                while at < len(whole):
                    end = whole.find(b" ", at + piece_bytes) + 1 or len(whole)
                    if len(whole) - end <= 1:  # the end byte stays with its last word
                        end = len(whole)
                    full = in_block and in_block + end - at > block_bytes
                    if held and (full or size + end - at > CHUNK_BYTES):
                        yield chunk(block, held)
                        held, size = [], 0
                    if full:
                        block, in_block = block + 1, 0
                    held.append((row, doc, train, whole[max(0, at - depth) : at].rjust(depth, END) + whole[at:end]))
                    size, in_block = size + end - at, in_block + end - at
                    at = end
                row += 1
        if held:
            yield chunk(block, held)

    return _lean(cut)


def _unpacked(chunks: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """(block, rows, doc_ids, trains, starts, sizes, bytes) of every chunk, one unpacked at a time."""
    for at in range(chunks.num_rows):
        block, *lists, body = (chunks.column(n)[at].as_py() for n in ("block", "row", "doc_id", "train", "size", "body"))
        sizes = np.asarray(lists[3], np.int64)
        yield block, *lists[:3], np.cumsum(sizes) - sizes, sizes, zstandard.ZstdDecompressor().decompress(body)


def grams(body: bytes, depth: int) -> np.ndarray:
    """Each byte behind the first ``depth`` ones, with the ``depth`` bytes before it, as one number."""
    eights = np.ndarray((max(len(body) - depth, 0),), ">u8", body + bytes(8), strides=(1,))
    return (eights.astype(np.uint64) >> np.uint64(8 * (7 - depth))).view(np.int64)


def words_of(body: bytes, starts: np.ndarray, depth: int) -> tuple[pa.Array, np.ndarray]:
    """Tokens of pieces that begin at ``starts``, each with the space behind it or the end, and the piece of each.

    No word holds a space or an end, and a piece begins behind one; what ends in the bytes before a piece is not its own.
    """
    data = np.frombuffer(body, np.uint8)
    at = np.flatnonzero((data == 32) | (data == END[0]))
    limits = np.zeros(len(at) + 1, np.int32)
    limits[1:] = at + 1
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(limits), pa.py_buffer(body)])
    piece = np.searchsorted(starts, at, "right") - 1
    own = at - starts[piece] >= depth
    return words.filter(pa.array(own)), piece[own]


class _Grams:
    """Distinct contexts and bytes of one block, with their number in training documents."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.waiting, self.size = depth, [], [], 0

    def add(self, trains: list[bool], starts: np.ndarray, sizes: np.ndarray, body: bytes) -> None:
        keys = grams(body, self.depth)
        inside = np.ones(len(body), bool)  # not those that begin in the last bytes of a piece
        inside[((starts + sizes)[:, None] - np.arange(1, self.depth + 1)).ravel()] = False
        train = np.repeat(np.asarray(trains, bool), sizes)
        for kind in (True, False):
            self.waiting.append((kind, keys[(inside & (train == kind))[: len(keys)]]))
        self.size += len(body)
        if self.size >= UNIQUE_BYTES:
            self.reduce()

    def reduce(self) -> None:
        for kind in (True, False):
            found = [g for train, g in self.waiting if train == kind]
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                self.parts.append((keys, n if kind else np.zeros_like(n)))
        self.waiting, self.size = [], 0
        if len(self.parts) > 2:
            self.parts = [self.united()]

    def united(self) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = np.unique(np.concatenate([k for k, _ in self.parts]), return_counts=True)  # with counts it sorts, which is faster
        n = np.zeros(len(keys), np.int64)
        for part, counts in self.parts:
            n[np.searchsorted(keys, part)] += counts
        return keys, n

    def batch(self, block: int) -> pa.RecordBatch:
        self.reduce()
        keys, n = self.united()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys), pa.array(n)], ["block", "gram", "n"])


class _Words:
    """Distinct tokens of one block, with their number in training documents."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.waiting, self.size = depth, [], [], 0

    def add(self, trains: list[bool], starts: np.ndarray, sizes: np.ndarray, body: bytes) -> None:
        words, piece = words_of(body, starts, self.depth)
        self.waiting.append((words, np.asarray(trains, np.int64)[piece]))
        self.size += len(body)
        if self.size >= WORD_BYTES:
            self.parts.append(self.united(self.waiting))
            self.waiting, self.size = [], 0
            if len(self.parts) > 2:
                self.parts = [self.united(self.parts)]

    def united(self, parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        words = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in parts]), len(words.dictionary))
        return words.dictionary, n.astype(np.int64)

    def batch(self, block: int) -> pa.RecordBatch:
        words, n = self.united(self.parts + self.waiting)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), words, pa.array(n)], ["block", "word", "n"])


def _count(kind: type, depth: int):
    """Chunks -> what each block needs to know. A block that two tasks read asks twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for block, _, _, *pieces in _unpacked(batch):
                if block != now:
                    if held:
                        yield from rows_of([held.batch(now)], 1 << 16)
                    now, held = block, kind(depth)
                held.add(*pieces)
        if held:
            yield from rows_of([held.batch(now)], 1 << 16)

    return _lean(count)


class _Table:
    """Values by number in an open table of twice their size, read a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at, left = self.places(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several, the last one stays
            stays = self.keys[at] == keys[left]
            self.values[at[stays]] = values[left[stays]]
            at, left = (at[~stays] + 1) & self.mask, left[~stays]

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        at = self.places(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            off = off[self.keys[at[off]] != keys[off]]
        return self.values[at]


def _score(depth: int):
    """Chunks of one block beside the answers for it -> sums of its pieces, and the training words first met in it."""

    def by_words(chunks: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        """(tokens, known ones, base) of every piece."""
        told = answers.select(["word", "value"]).filter(answers.column("word").is_valid())
        words = pa.array([], pa.binary()) if not len(told) else told.column("word").combine_chunks()
        count = told.column("value").to_numpy()
        del told
        logs = np.log10(count + ALPHA)
        waiting, size = [], 0

        def sums() -> Iterator[tuple]:
            """Pieces of the waiting chunks: the words of many are looked up at once, as the lookup is made anew each time."""
            found = pc.index_in(pa.chunked_array([x for x, _, _ in waiting], pa.binary()), value_set=words).to_numpy()
            base, seen = logs[found], count[found] > 0
            at = 0
            for _, piece, pieces in waiting:
                for n in np.bincount(piece, minlength=pieces).tolist():
                    own = slice(at, at + n)
                    yield n, int(seen[own].sum()), float(base[own].sum())
                    at += n

        for _, _, _, _, starts, _, body in _unpacked(chunks):
            waiting.append((*words_of(body, starts, depth), len(starts)))
            size += len(body)
            if size >= LOOKUP_BYTES:
                yield from sums()
                waiting, size = [], 0
        if waiting:
            yield from sums()

    def by_contexts(chunks: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        """(row, doc_id, train, bytes, bits) of every piece."""
        told = answers.select(["gram", "value"]).filter(answers.column("gram").is_valid())
        bits = _Table(told.column("gram").to_numpy(), told.column("value").to_numpy())
        del told
        for _, rows, docs, trains, starts, sizes, body in _unpacked(chunks):
            keys = grams(body, depth)
            cross = np.ones(len(body), bool)
            cross[((starts + sizes)[:, None] - np.arange(1, depth + 1)).ravel()] = False
            inside = np.flatnonzero(cross[: len(keys)])
            lengths = np.zeros(len(body))
            lengths[inside] = bits[keys[inside]]
            bounds = zip(starts.tolist(), sizes.tolist())
            spent = [float(lengths[a : a + n - depth].sum()) for a, n in bounds]
            yield from zip(rows, docs, trains, (sizes - depth).tolist(), spent)

    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        """Chunks are unpacked twice, so that the words' table is gone before that of the contexts is made."""
        spoken = list(by_words(chunks, answers))
        _give_back()
        new = pc.sum(answers.column("is_new")).as_py() or 0
        out = []
        for (n, known, base), (row, doc, train, n_bytes, spent) in zip(spoken, by_contexts(chunks, answers), strict=True):
            out.append((row, doc, train, n, known, n_bytes, base, spent, new))
            new = 0
        _give_back()
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in PARTS.split(", ")]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return score


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Γ(x) for x > 0 by Stirling's series, eight steps up; good to 1e-12."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi)
    inverse = 1 / (z * z)
    series = series + (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    low = x * (x + 1) * (x + 2) * (x + 3)
    high = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return series - np.log(low) - np.log(high)


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0, a batch of rows at a time."""

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        return pd.Series(_log_gamma(x.to_numpy(np.float64)))

    return value(x)


def kt_log(a: Column, b: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones.

    A batch of rows at a time: as column expressions the three series make one method too long for the JVM to compile.
    """

    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series) -> pd.Series:
        zeros, ones = a.to_numpy(np.float64), b.to_numpy(np.float64)
        out = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - LOG_PI
        return pd.Series(np.where(zeros + ones == 0, 0.0, out))

    return value(a, b)


NODE = "shiftleft(1, i) | shiftright(byte, 8 - i)"  # a one, then the bits of the byte before the i-th
BIT = "shiftright(byte, 7 - i) & 1"


def tree(counted: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Nodes (node, a, b, own, below) of the context trees at each depth, the deepest last.

    ``own`` is the logarithm of the node's estimate of all that followed its context, ``below`` that of the product of its
    children. Level by level, nodes are summed into the context without its first byte; map tasks
    sum first, so the shortest contexts are no hot keys.
    """
    context = counted.select(F.shiftright("gram", 8).alias("context"), F.expr("int(gram & 255)").alias("byte"), "n")
    choices = context.repartition("context").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    choices = choices.select("context", F.expr(NODE).alias("node"), F.expr(BIT).alias("bit"), "n")
    a, b = F.sum(F.expr("if(bit = 0, n, 0L)")), F.sum(F.expr("if(bit = 1, n, 0L)"))
    deepest = choices.groupBy("context", "node").agg(a.alias("a"), b.alias("b"))
    deepest = deepest.select(F.expr("shiftleft(context, 8) | node").alias("node"), "a", "b")
    own = kt_log(F.col("a"), F.col("b"))
    levels = [materialise(deepest.withColumn("own", own).withColumn("below", F.col("own")), f"tree_{depth}")]
    for d in range(depth - 1, -1, -1):
        high = F.greatest("own", "below")
        mixed = high + F.log((F.exp(F.col("own") - high) + F.exp(F.col("below") - high)) / 2)
        weighted = F.col("own") if d == depth - 1 else mixed
        rows = levels[0].select(F.col("node").bitwiseAND((1 << (8 * d + 8)) - 1).alias("node"), "a", "b", weighted.alias("w"))
        summed = rows.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("below"))
        levels.insert(0, materialise(summed.withColumn("own", own).select("node", "a", "b", "own", "below"), f"tree_{d}"))
    return levels


def predictions(levels: list[DataFrame]) -> DataFrame:
    """(node, p): probability that the next bit is one, for each of the deepest contexts.

    From the root to the leaves, ``acc`` is what the nodes so far contribute and ``rem`` the weight left for
    deeper ones. A node has at most 256 children, so no key of the joins is hot.
    """
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    w = 1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0))))
    now = levels[0].select("node", (w * one).alias("acc"), (1 - w).alias("rem"))
    for d in range(1, len(levels)):
        above = now.withColumnRenamed("node", "_up")
        up = F.col("node").bitwiseAND((1 << (8 * d)) - 1)
        joined = levels[d].withColumn("_up", up).join(above, "_up")
        weight = w if d < len(levels) - 1 else F.lit(1.0)
        now = joined.select("node", (F.col("acc") + F.col("rem") * weight * one).alias("acc"), (F.col("rem") * (1 - weight)).alias("rem"))
    return now.select("node", F.col("acc").alias("p"))


def code_lengths(counted: DataFrame, depth: int = DEPTH, levels: list[DataFrame] | None = None) -> DataFrame:
    """(gram, value): bits of a byte behind its context, for counted (gram, n); n may be 0. ``levels`` are its trees, if made.

    Contexts that no training document has count nothing and change no other node: their choices are even. The at most
    255 choices of a context are gathered into one row.
    """
    p = predictions(levels or tree(counted, depth)).select(
        F.shiftright("node", 8).alias("context"), F.struct(F.expr("int(node & 255)").alias("node"), "p").alias("e")
    )
    p = p.groupBy("context").agg(F.map_from_entries(F.collect_list("e")).alias("p"))
    rows = counted.select("gram", F.shiftright("gram", 8).alias("context"), F.expr("int(gram & 255)").alias("byte"))
    chosen = f"if(({BIT}) = 1, p[{NODE}], 1 - p[{NODE}])"
    value = f"aggregate(sequence(0, 7), 0D, (acc, i) -> acc - log2({chosen}))"
    return rows.join(p, "context").select("gram", F.expr(value).alias("value"))


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    piece_bytes: int = PIECE_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scores of every whole text, learned from the rows where ``train`` is true (missing: false).

    Per row: ``doc_id``, ``train``, ``n_tokens`` (words and the end), ``n_known`` (seen in training), ``train_tokens``, ``n_bytes``,
    ``base_score`` (log10 by word counts with 0.1 added), ``score`` (log10 by context trees) and ``bits_per_byte``. Training
    rows are scored by counts that hold them.

    Texts are cut into pieces that overlap by a context and written in blocks. A block asks for each of its contexts and
    words once; their counts are summed over all blocks, the trees are made from all of them, and the answers go back to the
    blocks that asked. A context or word has one row a block at most, so none is a hot key, and no task
    holds more than a block's texts and answers; nothing is broadcast. Input that comes in many small splits is read several
    splits a task, about a block of text in each: what is asked for follows the text, not how it is dealt. A text is cut only behind spaces: one
    word longer than a piece stays whole. Missing and empty texts are one end. Repeated rows are scored each; a
    table without training rows gives even choices; an empty table an empty result; other columns are not looked
    at.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.col(f"`{text_col}`").alias("text"),
    )
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    splits = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, -(-splits // max(1, block_bytes * splits // max(1, size)))))
    chunks = materialise(rows.mapInArrow(_cut(depth, piece_bytes, block_bytes), CHUNKS), "chunks")
    by_block = materialise(chunks.mapInArrow(_count(_Grams, depth), "block long, gram long, n long"), "contexts")
    counted = materialise(by_block.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    levels = tree(counted, depth)
    lengths = materialise(code_lengths(counted, depth, levels), "code_lengths")
    release(counted, *levels)
    same = Window.partitionBy("word")
    total = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(same.orderBy("block")) == 1
    words = (
        chunks.mapInArrow(_count(_Words, depth), "block long, word binary, n long")
        .select("block", "word", total.cast("double").alias("value"), first.alias("_first"))
        .select("block", F.lit(None).cast("long").alias("gram"), "word", "value", (F.col("_first") & (F.col("value") > 0)).alias("is_new"))
    )
    contexts = by_block.join(lengths, "gram").select(
        "block", "gram", F.lit(None).cast("binary").alias("word"), "value", F.lit(None).cast("boolean").alias("is_new")
    )
    parts = chunks.groupBy("block").cogroup(contexts.union(words).groupBy("block")).applyInArrow(_score(depth), PARTS)
    parts = materialise(parts, "scores")
    release(chunks, by_block, lengths)
    known = parts.agg(F.sum("n_new"), F.sum(F.expr("if(train, n_tokens, 0)"))).first()
    n_words, n_train = known[0] or 0, known[1] or 0
    scale = math.log10(n_train + ALPHA * (n_words + 1))
    summed = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("train").alias("train"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base", "bits")],
    )
    return summed.select(
        "doc_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "n_bytes",
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


@query("op11_context_trees")
def op11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    scored = score_texts(docs, fold != 0)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        F.round("base_score", 6).alias("base_score"),
        F.round("score", 6).alias("score"),
        "n_bytes",
        F.round("bits_per_byte", 6).alias("bits_per_byte"),
    )
