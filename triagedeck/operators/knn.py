"""Exact nearest-neighbour join in two passes.

The training rows are divided into cells around pivot rows, about the root of their number, and heavy cells into
rings by the distance to their pivot. The first pass searches one block of each query's own cell, which
bounds its k-th distance. The second visits the blocks that the triangle inequality does not rule
out at that distance. Queries are copied, one for each block they visit; a training row lies in one block. Blocks have
a bounded number of rows and hold still while their visitors stream past.

Where little is ruled out, as in many equal dimensions, copies for each block would be the whole cost. So
neighbouring blocks travel as tiles, and a query is copied once for each tile. Inside a tile a pass in
single precision with room for its rounding leaves few pairs, and only these are measured in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ranks import hash_order

BLOCK_ROWS = 8192
TILE_ROWS = 1 << 14  # rows that travel together
VISITOR_ROWS = 1 << 14  # visitors of one copy of a tile
PAIRS = 2_000_000  # distances held at a time
STRIP = 1 << 16  # distances summed at a time, which stay in a core's cache
SLACK = 1e-9  # guards the pruning bounds against rounding
MOST_TASKS = 1 << 12  # of one search
LARGE = 1e9  # beyond this, powers are not taken in single precision
SMALL = 1e-30  # covers what single precision loses near zero


def _powers(gap: np.ndarray, p: int) -> np.ndarray:
    """Powers of the absolute values, in place."""
    if p == 1:
        return np.abs(gap, out=gap)
    if p == 2:
        return np.multiply(gap, gap, out=gap)
    if p == 3:
        return np.multiply(np.abs(gap, out=gap), gap * gap, out=gap)
    return np.power(np.abs(gap, out=gap), p, out=gap)


def _sums(a: np.ndarray, b: np.ndarray, p: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sums of powers of all rows of ``a`` to all rows of ``b``, in strips (first row, first column, sums)."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    wide = max(1, min(b.shape[1], STRIP // 16))
    high = max(1, STRIP // wide)
    for i in range(0, a.shape[1], high):
        for j in range(0, b.shape[1], wide):
            left, right = a[:, i : i + high, None], b[:, None, j : j + wide]
            total = np.zeros((left.shape[1], right.shape[2]), a.dtype)
            gap = np.empty_like(total)
            for d in range(len(a)):
                total += _powers(np.subtract(left[d], right[d], out=gap), p)
            yield i, j, total


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all rows of ``b``."""
    total = np.zeros((len(a), len(b)))
    for i, j, part in _sums(a, b, p):
        total[i : i + part.shape[0], j : j + part.shape[1]] = part
    return total if p == 1 else total ** (1.0 / p)


def _pair_distances(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Distances of the rows ``left`` of ``a`` to the rows ``right`` of ``b``, the same as those of all pairs."""
    total = np.zeros(len(left))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for start in range(0, len(left), STRIP):
        few = slice(start, start + STRIP)
        for d in range(len(a)):
            total[few] += _powers(a[d][left[few]] - b[d][right[few]], p)
    return total if p == 1 else total ** (1.0 / p)


class Tile:
    """Training vectors in ascending order of id, and their form in single precision.

    Of equal vectors only the first ``k`` are kept: the others come after these for every query.
    """

    def __init__(self, vectors: np.ndarray, k: int, p: int):
        whole = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
        _, same, times = np.unique(whole.view(f"V{whole.itemsize * whole.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(order)) - np.repeat(np.cumsum(times) - times, times)
        self.rows = np.sort(order[nth < k])
        self.vectors, self.p = whole[self.rows], p
        fine = self.vectors[np.isfinite(self.vectors).all(axis=1)]
        self.centre = fine.mean(axis=0) if len(fine) else np.zeros(whole.shape[1])
        moved = self.vectors - self.centre
        self.most = np.max(np.abs(moved), initial=0.0)
        self.forms = {kind: self._form(moved.astype(kind)) for kind in ([np.float32] if self.most < LARGE else [np.float64])}
        self.moved = moved
        self.length = (np.abs(moved) ** p).sum(axis=1).max(initial=0.0) ** (1.0 / p)

    def _form(self, moved: np.ndarray) -> np.ndarray:
        if self.p != 2:
            return moved
        half = -(moved.astype(np.float64) ** 2).sum(axis=1) / 2
        return np.ascontiguousarray(np.column_stack([moved, half.astype(moved.dtype)]).T)

    def near(self, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) with all those within the bound of the query; a missing value is within it."""
        moved = asked - self.centre
        kind = np.float32 if max(self.most, np.max(np.abs(moved), initial=0.0)) < LARGE else np.float64
        form = self.forms.get(kind)
        if form is None:
            form = self.forms[kind] = self._form(self.moved.astype(kind))
        eps, width = float(np.finfo(kind).eps), moved.shape[1] + 8
        length = (np.abs(moved) ** self.p).sum(axis=1) ** (1.0 / self.p)
        if self.p == 2:  # a.b - b.b / 2 is at least (a.a - bound^2) / 2
            error = 4 * width * eps * (length**2 + self.length**2) + SMALL
            least = ((length**2 - bound**2 - error) / 2).astype(kind)
            products = np.column_stack([moved.astype(kind), np.ones(len(moved), kind)]) @ form
            return np.nonzero(~(products < least[:, None]))
        reach = bound + 2 * eps * (length + self.length)
        limit = reach**self.p * (1 + 2 * width * eps) + SMALL
        with np.errstate(over="ignore"):
            limit = limit.astype(kind)
        found = []
        for i, j, part in _sums(moved.astype(kind), form, self.p):
            row, column = np.nonzero(~(part > limit[i : i + len(part), None]))
            found.append((row + i, column + j))
        return tuple(np.concatenate(x) for x in zip(*found))

    def nearest(self, asked: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the ``k`` nearest rows within the bounds; equal distances: the first row."""
        query, row = self.near(asked, bound)
        gap = _pair_distances(asked, self.vectors, query, row, self.p)
        order = np.lexsort((row, gap, query))
        query, row, gap = query[order], row[order], gap[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        best = nth < k
        return query[best], self.rows[row[best]], gap[best]


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column without missing entries as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pick_pivots(train: DataFrame, n: int) -> np.ndarray:
    """``n`` training vectors in seeded random order; their number is about the root of the table's."""
    rows = train.orderBy(hash_order("pivot", "id"), "id").select("v").limit(n).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


@dataclass(frozen=True)
class Blocks:
    """What the driver knows of the training side: pivots, and the rings of each cell.

    Ring ``j`` of cell ``cell[j]`` holds rows whose distance to the pivot lies from ``low`` to ``high``, in ``parts``
    blocks. There is a ring for every block's worth of rows, and one a cell at least. ``rows`` counts its rows.
    """

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    p: int
    rows: np.ndarray

    def tiles(self, tile_rows: int) -> list[np.ndarray]:
        """The tile of each block, as an array for each ring.

        Blocks are strung in an order that keeps near pivots together, and cut by their number of rows.
        """
        place = np.argsort(_strung(self.pivots))
        order = np.lexsort((self.low, place[self.cell]))
        size = np.repeat((self.rows / self.parts)[order], self.parts[order])
        number = ((np.cumsum(size) - size) // tile_rows).astype(np.int32)
        found = dict(zip(order, np.split(number, np.cumsum(self.parts[order])[:-1])))
        return [found[j] for j in range(len(order))]

    def reachable(self, gap: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Rings (query, ring) that may hold a row nearer than ``bound``, from the distances to the pivots.

        A row keeps its distance to its own pivot, and is nearer to that than to any other pivot.
        """
        to = gap[:, self.cell]
        least = np.maximum(self.low[None, :] - to, to - self.high[None, :])
        least = np.maximum(least, (to - gap.min(axis=1)[:, None]) / 2)
        return least <= bound[:, None] + SLACK * (1.0 + np.abs(to))


def _strung(points: np.ndarray) -> np.ndarray:
    """Numbers of the points, halved again and again along their widest axis."""
    heap, found = [np.arange(len(points))], []
    while heap:
        part = heap.pop()
        if len(part) < 3:
            found.append(part)
            continue
        here = points[part]
        part = part[np.argsort(here[:, np.argmax(here.max(axis=0) - here.min(axis=0))], kind="stable")]
        heap += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.concatenate(found)


def _in_cells(pivots: np.ndarray, p: int):
    """Add the nearest pivot and the distance to it to rows whose second column is the vector."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(_vectors(batch.column(1)), pivots, p)
                cell = gap.argmin(axis=1)
                more = [pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(gap)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "gap"])

    return near


def _rings(celled: DataFrame, pivots: np.ndarray, p: int, block_rows: int) -> tuple[DataFrame, Blocks]:
    """Training rows with their ring and block, and the limits of all rings."""
    cells = celled.groupBy("cell").agg(F.max("gap").alias("_far"), F.count(F.lit(1)).alias("_n"))
    rows = celled.join(cells, "cell")
    n_rings = F.ceil(F.col("_n") / block_rows)
    nth = F.when(F.col("_far") > 0, F.least(F.floor(F.col("gap") / F.col("_far") * n_rings), n_rings - 1)).otherwise(0)
    rows = materialise(rows.withColumn("ring", nth.cast("int")).drop("_far", "_n"), "train_cells")
    found = (
        rows.groupBy("cell", "ring")
        .agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("n"))
        .orderBy("cell", "ring")
        .collect()
    )
    columns = [np.array([r[c] for r in found]) for c in ("cell", "low", "high", "n")]
    blocks = Blocks(pivots, *columns[:3], -(-columns[3] // block_rows), p, columns[3])
    numbers = celled.sparkSession.createDataFrame(
        [(r.cell, r.ring, j, int(blocks.parts[j])) for j, r in enumerate(found)], "cell int, ring int, unit int, parts int"
    )
    placed = rows.join(numbers, ["cell", "ring"])
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    return placed.select("unit", part, "id", "v", *[c for c in celled.columns if c not in ("cell", "gap", "id", "v")]), blocks


def _first_visits(blocks: Blocks, k: int):
    """Each query to one block of the ring around its nearest pivot that suits its distance."""
    p, pivots = blocks.p, blocks.pivots

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(_vectors(batch.column(1)), pivots, p)
                own = gap.argmin(axis=1)
                near = np.minimum(*(np.abs(x[None, :] - gap[:, blocks.cell]) for x in (blocks.low, blocks.high)))
                near[blocks.cell[None, :] != own[:, None]] = np.inf
                unit = near.argmin(axis=1)
                bound = np.partition(gap, k - 1, axis=1)[:, k - 1] if len(pivots) >= k else np.full(len(gap), np.inf)
                ids = batch.column(0).to_numpy()
                more = [unit.astype(np.int32), (ids % blocks.parts[unit]).astype(np.int32), bound]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], ["id", "v", "unit", "part", "bound"])

    return visit


def _tiles_to_visit(blocks: Blocks, tiles: list[np.ndarray]):
    """Each query to all other tiles with a block within its bound. Rows: id, v, unit (searched already), part, bound."""
    p, pivots = blocks.p, blocks.pivots
    holds = np.zeros((len(tiles), 1 + max(t.max() for t in tiles)), np.float32)
    for ring, own in enumerate(tiles):
        holds[ring, own] = 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                gap = distances(_vectors(batch.column(1)), pivots, p)
                wanted = blocks.reachable(gap, batch.column(4).to_numpy()).astype(np.float32) @ holds > 0
                wanted[np.arange(len(wanted)), batch.column(2).to_numpy()] = False
                row, tile = np.nonzero(wanted)
                take = pa.array(row)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(tile.astype(np.int32))]
                columns += [pa.array(np.zeros(len(row), np.int32)), batch.column(4).take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "unit", "part", "bound"])

    return visit


def _further_visits(blocks: Blocks):
    """Each query to all other blocks within its bound. Rows: id, v, unit, part (searched already), bound."""
    p, pivots = blocks.p, blocks.pivots

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                gap = distances(_vectors(batch.column(1)), pivots, p)
                row, ring = np.nonzero(blocks.reachable(gap, batch.column(4).to_numpy()))
                many = blocks.parts[ring]
                at = np.repeat(np.arange(len(row)), many)
                part = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                row, ring = row[at], ring[at]
                new = (ring != batch.column(2).to_numpy()[row]) | (part != batch.column(3).to_numpy()[row])
                row, ring, part = row[new], ring[new], part[new]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(ring.astype(np.int32)), pa.array(part.astype(np.int32))],
                    ["id", "v", "unit", "part"],
                )

    return visit


def _search(k: int, p: int, carried: Sequence[str]):
    """Blocks, each with its visitors behind it -> the k nearest rows of the block for each visitor."""

    def nearest(block: pa.Table, visitors: pa.RecordBatch, tile: Tile) -> Iterator[pa.RecordBatch]:
        for start in range(0, visitors.num_rows, step := max(1, PAIRS // len(tile.rows))):
            few = visitors.slice(start, step)
            query, row, gap = tile.nearest(_vectors(few.column("v")), few.column("bound").to_numpy(), k)
            take = pa.array(row)
            columns = [
                pa.array(few.column("id").to_numpy()[query]),
                block.column("id").take(take).combine_chunks(),
                pa.array(gap),
                *[block.column(c).take(take).combine_chunks() for c in carried],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "neighbour_id", "distance", *carried])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, tile = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("unit", "part", "copy", "asks")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if hi == lo:
                    continue
                rows = batch.slice(lo, hi - lo)
                *place, asks = keys[:, lo]
                if tuple(place) != now:
                    now, held, block = tuple(place), [], None
                if not asks:
                    held.append(rows)
                elif held:
                    if block is None:
                        block = pa.Table.from_batches(held).sort_by("id")
                        tile = Tile(_vectors(block.column("v").combine_chunks()), k, p)
                    yield from nearest(block, rows, tile)

    return search


def _searched(
    visits: DataFrame, placed: DataFrame, k: int, p: int, carried: Sequence[str], visitor_rows: int
) -> DataFrame:
    """The k nearest rows of each visited block, of those within the ``bound`` of the query where it has one.

    Blocks and visitors are dealt by block and sorted, the block's rows first, so a task holds one block
    and any number of visitors. Only where a block has more than ``visitor_rows`` of them it gets
    a second copy. Every copy has a slot; slots go round the tasks, so that the dealing is even.
    """
    spark = visits.sparkSession
    crowds = visits.groupBy("unit", "part").count().orderBy("unit", "part").collect()  # one row a block
    copies = [-(-r["count"] // visitor_rows) for r in crowds]
    slots = list(accumulate(copies, initial=0))
    n_tasks = min(max(1, slots.pop()), MOST_TASKS)
    places = spark.createDataFrame(
        [(r["unit"], r["part"], c, s) for r, c, s in zip(crowds, copies, slots)], "unit int, part int, copies int, slot int"
    )
    rows = placed.join(F.broadcast(places), ["unit", "part"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    asked = visits.join(F.broadcast(places), ["unit", "part"]).withColumn(
        "copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")
    )
    kinds = dict(placed.dtypes)
    task = ((F.col("slot") + F.col("copy")) % n_tasks).alias("task")
    bound = F.col("bound") if "bound" in visits.columns else F.lit(math.inf)
    both = rows.select(task, "unit", "part", "copy", F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("double").alias("bound"), *carried).union(
        asked.select(task, "unit", "part", "copy", F.lit(1).alias("asks"), "id", "v", bound.alias("bound"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carried])
    )
    dealt = both.repartitionById(n_tasks, "task").sortWithinPartitions("unit", "part", "copy", "asks")
    more = "".join(f", `{c}` {kinds[c]}" for c in carried)
    return dealt.mapInArrow(_search(k, p, carried), f"query_id long, neighbour_id long, distance double{more}")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sides(df: DataFrame, key: str, vector: str, carried: Sequence[str] = ()) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *carried)
    return rows.filter(F.col("v").isNotNull())


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    key: str,
    vector: str,
    k: int,
    p: int = 2,
    n_pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    carried: Sequence[str] = (),
    visitor_rows: int = VISITOR_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(query id, neighbour id, distance, rank) of the k nearest training rows, with the ``carried`` columns of these.

    Equal distances: the lower neighbour id wins. Rows without a vector take no part. The driver holds the pivots, by default
    as many as the root of the training rows, and the limits of one ring per block.
    """
    base = materialise(_sides(train, key, vector, carried), "train_side")
    n = base.count()
    if not n:
        raise ValueError("the training side is empty")
    pivots = _pick_pivots(base, max(1, n_pivots or math.ceil(math.sqrt(n))))
    kinds = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    celled = materialise(base.mapInArrow(_in_cells(pivots, p), f"{kinds}, cell int, gap double"), "train_near")
    placed, blocks = _rings(celled, pivots, p, block_rows)
    tiles = blocks.tiles(tile_rows)
    numbers = [(ring, part, int(t)) for ring, own in enumerate(tiles) for part, t in enumerate(own)]
    numbers = F.broadcast(base.sparkSession.createDataFrame(numbers, "unit int, part int, tile int"))

    def tiled(rows: DataFrame, *columns: str) -> DataFrame:
        tile = [F.col("tile").alias("unit"), F.lit(0).alias("part")]
        return rows.join(numbers, ["unit", "part"]).select("id", "v", *tile, *columns)

    placed = materialise(tiled(placed, *carried), "train_tiles")
    asked = _sides(queries, key, vector)
    place = "id long, v array<double>, unit int, part int, bound double"
    first = materialise(tiled(asked.mapInArrow(_first_visits(blocks, k), place), "bound"), "first_visits")
    near = materialise(_searched(first, placed, k, p, carried, visitor_rows), "first_pass")
    kth = _nearest(near, k).groupBy("query_id").agg(F.max("distance").alias("_d"), F.count(F.lit(1)).alias("_k"))
    bounded = first.join(kth.withColumnRenamed("query_id", "id"), "id", "left").select(
        "id", "v", "unit", "part", F.when(F.col("_k") == k, F.least("bound", "_d")).otherwise(F.col("bound")).alias("bound")
    )
    further = materialise(bounded.mapInArrow(_tiles_to_visit(blocks, tiles), place), "further_visits")
    return _nearest(near.union(_searched(further, placed, k, p, carried, visitor_rows)), k)


def _labelled(neighbours: DataFrame, train: DataFrame, key: str, label: str) -> DataFrame:
    """Neighbours with their label as ``_y``: carried by the join, or looked up."""
    if label in neighbours.columns:
        return neighbours.withColumn("_y", F.col(label))
    return neighbours.join(train.select(F.col(key).alias("neighbour_id"), F.col(label).alias("_y")), "neighbour_id")


def knn_predict(
    neighbours: DataFrame, train: DataFrame, key: str, label: str, weights: str = "uniform"
) -> DataFrame:
    """Class probability and vote of every query.

    ``distance`` weights by 1/distance; a zero distance takes all the weight.
    """
    voted = _labelled(neighbours, train, key, label)
    if weights == "uniform":
        plain = F.lit(1.0)
        votes = voted.groupBy("query_id").agg(
            F.sum(plain * F.col("_y")).alias("one"), F.sum(plain).alias("all")
        )
    else:
        zero = F.col("distance") == 0
        inverse = F.when(~zero, F.lit(1.0) / F.col("distance")).otherwise(0.0)
        sums = voted.groupBy("query_id").agg(
            F.count_if(zero).alias("nz"),
            F.count_if(zero & (F.col("_y") == 1)).alias("z1"),
            F.sum(inverse * F.col("_y")).alias("i1"),
            F.sum(inverse).alias("i"),
        )
        votes = sums.select(
            "query_id",
            F.when(F.col("nz") > 0, F.col("z1").cast("double")).otherwise(F.col("i1")).alias("one"),
            F.when(F.col("nz") > 0, F.col("nz").cast("double")).otherwise(F.col("i")).alias("all"),
        )
    prob = F.col("one") / F.col("all")
    return votes.select("query_id", prob.alias("prob"), (prob > 0.5).cast("int").alias("pred"))


def knn_trials(
    neighbours: DataFrame, train: DataFrame, key: str, label: str, ks: Sequence[int]
) -> DataFrame:
    """(query_id, k, weights, prob) for every k and both weightings from one neighbour table.

    The table must hold the largest k; a smaller one uses the first ranks.
    """
    voted = _labelled(neighbours, train, key, label)
    zero = F.col("distance") == 0
    inverse = F.when(~zero, F.lit(1.0) / F.col("distance"))
    aggs, cells = [], []
    for k in ks:
        within = F.col("rank") <= k
        aggs += [
            F.avg(F.when(within, F.col("_y"))).alias(f"u{k}"),
            F.avg(F.when(within & zero, F.col("_y"))).alias(f"z{k}"),
            (F.sum(F.when(within, inverse * F.col("_y"))) / F.sum(F.when(within, inverse))).alias(f"d{k}"),
        ]
        for name, prob in (("uniform", F.col(f"u{k}")), ("distance", F.coalesce(f"z{k}", f"d{k}"))):
            cells.append(F.struct(F.lit(k).alias("k"), F.lit(name).alias("weights"), prob.alias("prob")))
    return voted.groupBy("query_id").agg(*aggs).select("query_id", F.inline(F.array(*cells)))
