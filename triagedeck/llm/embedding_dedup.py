"""Near-equal vectors: tiles compared along principal axes, leading ones first."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import query, range_cuts, table
from .components import components

BLOCK_ROWS = 4096  # vectors in a block; a tile holds two blocks
CHUNK = 256  # rows of a tile compared at once
SLACK = 1e-5  # what rounding may take from a bound


def usable(v: Column) -> Column:
    """Whether a vector has a direction."""
    wide = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one width; scaled by the largest component first, so nothing overflows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        widths = np.asarray(batch.column(column).value_lengths())
        for width in np.unique(widths):
            yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def _moments(width: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for got, batch in _by_width(batches, 0):
            if got == width:
                x = _matrix(batch.column(0))
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"]
        )

    return moments


def principal_axes(vectors: DataFrame, col: str = "embedding") -> tuple[int, np.ndarray]:
    """The commonest width and its axes, the widest spread first, from all vectors of that width."""
    widths = vectors.groupBy(F.size(col).alias("w")).count()
    top = widths.orderBy(F.desc("count"), "w").first()
    if top is None:
        return 0, np.zeros((0, 0))
    sums = vectors.select(col).mapInArrow(_moments(top.w), "i int, j int, v double")
    total = np.zeros((top.w, top.w))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width**2 / 2 rows
        total[r.i, r.j] = total[r.j, r.i] = r.v
    return top.w, np.linalg.eigh(total)[1][:, ::-1]


def _turn(x: np.ndarray, width: int, axes: np.ndarray) -> np.ndarray:
    return x @ axes if x.shape[1] == width else x


def _first_axis(width: int, axes: np.ndarray):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _by_width(batches, 2):
            lead = _turn(_matrix(batch.column(2)), width, axes)[:, 0]
            mixed = np.asarray(batch.column(0), np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            lead = lead + 1e-9 * (mixed >> np.uint64(40)).astype(np.float64) / 2**24  # parts equal values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lead)], ["cls", "n", "embedding", "lead"]
            )

    return first


def _deal(cuts: list[float], reach: float):
    """Copies of a vector for the tiles of its block and each block that its reach touches."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high, second = [], [], [], []
            for i, lead in enumerate(batch.column(3).to_pylist()):
                own = bisect_left(cuts, lead)
                for other in range(bisect_left(cuts, lead - reach), bisect_right(cuts, lead + reach) + 1):
                    at.append(i)
                    low.append(min(own, other))
                    high.append(max(own, other))
                    second.append(other < own)
            rows = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x, pa.int32()) for x in (low, high)),
                    pa.array(second, pa.bool_()),
                    rows.column(2).value_lengths().cast(pa.int32()),
                    *rows.columns,
                ],
                ["low", "high", "second", "width", "cls", "n", "embedding"],
            )

    return deal


def near_pairs(z: np.ndarray, n_first: int, same: bool, threshold: float):
    """Index pairs (of the first n_first rows with the others) whose cosine may reach the threshold.

    Products of the leading coordinates come first; what the others can add is at most the product
    of their norms. Pairs that cannot reach the threshold stop there; the rest take in more coordinates.
    """
    width = z.shape[1]
    steps = sorted({max(1, width // 4), max(1, width // 2), width})
    tail = np.sqrt(np.maximum(0, 1 - np.cumsum(z * z, axis=1)))
    # leading coordinates with the norm of the rest as one more: the product is the bound itself
    lead = np.column_stack([z[:, : steps[0]], tail[:, steps[0] - 1]]).astype(np.float32)
    first, second = np.arange(n_first), np.arange(0 if same else n_first, len(z))
    for at in range(0, n_first, CHUNK):
        bound = lead[first[at : at + CHUNK]] @ lead[second].T
        i, j = np.nonzero(bound >= threshold - SLACK)
        i, j = first[i + at], second[j]
        if same:
            i, j = i[i < j], j[i < j]
        sums, done = np.einsum("ij,ij->i", z[i, : steps[0]], z[j, : steps[0]]), steps[0]
        for upto in steps[1:]:
            sums = sums + np.einsum("ij,ij->i", z[i, done:upto], z[j, done:upto])
            keep = sums + tail[i, upto - 1] * tail[j, upto - 1] >= threshold - SLACK
            i, j, sums, done = i[keep], j[keep], sums[keep], upto
        yield i, j


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each points at the smallest row of its set) after linking i with j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]


def _compare(threshold: float, width: int, axes: np.ndarray):
    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("second", "ascending"), ("cls", "ascending")])
        cls = np.asarray(tile["cls"].combine_chunks(), np.int64)
        n = np.asarray(tile["n"].combine_chunks(), np.int64)
        same = tile["low"][0] == tile["high"][0]
        n_first = len(cls) - int(np.asarray(tile["second"].combine_chunks()).sum())
        x = _matrix(tile["embedding"])
        links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for i, j in near_pairs(_turn(x, width, axes), n_first, same, threshold):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            label = join_labels(label, i, j)
        some = np.flatnonzero(links)
        return pa.table(
            {"cls": cls[some], "links": links[some], "root": cls[label[some]]},
            pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]),
        )

    return compare


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``
    (above 0). Equal vectors are one class with a count, so groups of copies are compared once.
    Classes are ordered by the first principal axis and cut into blocks; a tile compares two blocks,
    unless their distance along that axis already rules a link out. A tile returns a count and
    a root for each of its vectors, never pairs. The search is exact.

    Vectors that are missing, empty, zero, or hold missing or non-finite components link with nothing;
    so do vectors of different widths. ``component_id`` is the smallest id reachable, missing
    only where all ids reachable are. Repeated rows and rows that share an id are vertices of their own.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    ok = usable(F.col("embedding"))
    key = F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y"))
    rows = rows.withColumn("_key", F.when(ok, key))
    classes = materialise(
        rows.filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "vector_classes",
    )
    width, axes = principal_axes(classes)
    kind = vectors.schema[vector_col].dataType.simpleString()
    led = materialise(
        classes.select("cls", "n", "embedding").mapInArrow(
            _first_axis(width, axes), f"cls long, n long, embedding {kind}, lead double"
        ),
        "vectors_by_axis",
    )
    cuts = range_cuts(led, "lead", block_rows)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    found = materialise(
        led.mapInArrow(
            _deal(cuts, reach),
            f"low int, high int, second boolean, width int, cls long, n long, embedding {kind}",
        )
        .groupBy("width", "low", "high")
        .applyInArrow(_compare(threshold, width, axes), "cls long, links long, root long"),
        "vector_links",
    )
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    ids = rows.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("vec_id").alias("low_id"))
    known = materialise(
        classes.select("_key", "cls", "n")
        .join(ids, "_key")
        .join(sums, "cls", "left")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .select(
            "_key",
            "low_id",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "cls").alias("root"),
        ),
        "vector_members",
    )
    lowest = known.groupBy("root").agg(F.min("low_id").alias("component_id"))
    members = materialise(
        known.join(materialise(lowest, "vector_lowest"), "root").select("_key", "n_links", "component_id"),
        "vector_components",
    )
    out = rows.select("vec_id", "_key").join(members, "_key", "left")
    component = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""


@query("op5_near_vectors", VECTORS_SQL)
def op5(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))
