"""Repair of conversations: the cheapest edits that give alternating turns, found by divide and conquer.

Roles are read as their first letter, and a repaired conversation spells ``(s?(ua)+)?``. While it is read from the
left, one of four states holds: nothing yet, after the system turn, after a user turn, after an assistant turn. A
step (one row, or a run of rows) is four by four costs, with the order of the audits that reach
each state. Steps compose, so a run of any length is 32 numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import place
from ..session import materialise
from .base import SPACE, in_order, query, rows_of, table
from .merkle import crc_sql

INF = 1 << 60
STATES = range(4)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # after one more turn of the alternation
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "u", 3: "a"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
TAIL = {0: 0, 3: 0, 2: 1, 1: 2}  # turns to insert at the end, by state
LAWFUL = {("s", "u"), ("u", "a"), ("a", "u")}
SEGMENT_BITS = 12  # rows of one segment: 4,096 places of the sorted table
TIER_BITS = 10  # segments of one run of segments, on each tier

Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # costs, ranks: [from][to]
Vector = tuple[list[int], list[int]]  # costs, ranks


@lru_cache(maxsize=None)
def row_edits(kind: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """Cheapest edits of one row, [from][to] as (cost, audit), with the turns inserted before it.

    ``kind`` is the role's letter (o: another one), upper case if the text breaks off, x if the row has to go.
    """
    role, extra = kind.lower(), CUT * kind.isupper()
    found = [[(INF, "")] * 4 for _ in STATES]
    for start in STATES:
        state = start
        for n in range(3):
            ways = [(DELETE, "D", state)]
            if role != "x":
                ways.append((REROLE + extra, "R", NEXT[state]))
                if (state, role) in READS:
                    ways.append((extra, "K", READS[state, role]))
            for cost, edit, end in ways:
                found[start][end] = min(found[start][end], (INSERT * n + cost, "I" * n + edit))
            state = NEXT[state]
    return tuple(tuple(r) for r in found)


def _ranked(best: Sequence[tuple]) -> Vector:
    """Costs of (cost, order...), and the place of each order among those that can be reached."""
    order = sorted(e for e in STATES if best[e][0] < INF)
    order.sort(key=lambda e: best[e][1:])
    ranks = [0] * 4
    for place_, e in enumerate(order):
        ranks[e] = place_
    return [b[0] for b in best], ranks


def _matrix(rows: Sequence[Vector]) -> Step:
    return tuple(tuple(r[0]) for r in rows), tuple(tuple(r[1]) for r in rows)


@lru_cache(maxsize=None)
def row_step(kind: str) -> Step:
    return _matrix([_ranked(r) for r in row_edits(kind)])


def forward(vector: Vector, step: Step) -> Vector:
    """Costs after one more step, and the order of the least audits that reach each state.

    Audits of the same rows that end in a row's own edit are never prefixes of each other, and one audit leads to one
    state; so the order before the step decides, then that of the step.
    """
    (costs, ranks), (more, order) = vector, step
    reached = [m for m in STATES if costs[m] < INF]
    best = []
    for e in STATES:
        ways = [(costs[m] + more[m][e], ranks[m], order[m][e]) for m in reached if more[m][e] < INF]
        best.append(min(ways) if ways else (INF, 0, 0))
    return _ranked(best)


def backward(step: Step, costs: Sequence[int]) -> list[int]:
    """Costs from each state, before the step, to the end."""
    return [min(min(step[0][s][e] + costs[e] for e in STATES), INF) for s in STATES]


def started(state: int) -> Vector:
    return [0 if s == state else INF for s in STATES], [0] * 4


def composed(steps: Sequence[Step]) -> Step:
    """All steps as one."""
    rows = []
    for s in STATES:
        vector = started(s)
        for step in steps:
            vector = forward(vector, step)
        rows.append(vector)
    return _matrix(rows)


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The state before each step on the cheapest way from ``start`` to ``end``, the least audit among equals.

    Forward and backward cost vectors meet in the middle; the state of least cost whose audit comes
    first is crossed, and both halves follow alone. Only the vectors of one cut are held at a time.
    """
    out = [0] * len(steps)
    work = [(0, len(steps), start, end)]
    while work:
        lo, hi, s, e = work.pop()
        if hi - lo == 1:
            out[lo] = s
            continue
        mid = (lo + hi) // 2
        left = started(s)
        for k in range(lo, mid):
            left = forward(left, steps[k])
        right = started(e)[0]
        for k in range(hi - 1, mid - 1, -1):
            right = backward(steps[k], right)
        cross = min((left[0][m] + right[m], left[1][m], m) for m in STATES)[2]
        work += [(lo, mid, s, cross), (mid, hi, cross, e)]
    return out


def best_end(step: Step) -> tuple[int, int]:
    """Cheapest (cost, last state) of a whole conversation, turns added at its end included."""
    costs, ranks = step[0][0], step[1][0]
    cost, _, end = min((costs[e] + INSERT * TAIL[e], ranks[e], e) for e in STATES)
    return cost, end


@lru_cache(maxsize=4096)
def _short(kinds: str, start: int, end: int) -> tuple[str, ...]:
    return tuple(_edits(kinds, start, end))


def _edits(kinds: str, start: int, end: int) -> list[str]:
    """Each row's audit between two states, followed by the letters of the roles it gives.

    ``IK:u`` inserts a user turn and keeps the row, ``R:a`` makes it an assistant turn.
    """
    before = crossings([row_step(k) for k in kinds], start, end)
    out = []
    for kind, s, e in zip(kinds, before, [*before[1:], end]):
        audit, letters = row_edits(kind)[s][e][1], []
        for c in audit:
            if c == "I" or c == "R":
                s = NEXT[s]
                letters.append(ROLE[s])
        out.append(f"{audit}:{''.join(letters)}")
    return out


@lru_cache(maxsize=4096)
def _short_step(kinds: str) -> Step:
    return composed([row_step(k) for k in kinds])


def _flat(m: Sequence[Sequence[int]]) -> list[int]:
    return [x for r in m for x in r]


def _step(costs: Sequence[int], ranks: Sequence[int]) -> Step:
    return tuple(tuple(costs[i : i + 4]) for i in (0, 4, 8, 12)), tuple(tuple(ranks[i : i + 4]) for i in (0, 4, 8, 12))


SEGMENT = (
    "conv_id long, seg long, first_pos long, kinds string, costs array<long>, ranks array<long>, n_blank long,"
    " n_duplicate long, n_truncated long, n_illegal long, first_role string, last_role string,"
    " min_turn long, max_turn long, n_turns long"
)


def _segments(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in order -> one row for each conversation in each segment."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    kind_of = {"conv_id": pa.int64(), "kinds": pa.string(), "first_role": pa.string(), "last_role": pa.string()}
    kind_of |= {n: pa.list_(pa.int64()) for n in ("costs", "ranks")}
    schema = pa.schema([(n, kind_of.get(n, pa.int64())) for n in names])
    done: list[tuple] = []
    key, kinds, roles, turns, faults, first = None, [], [], [], [], 0

    def close() -> None:
        text = "".join(kinds)
        step = _short_step(text) if len(text) <= 64 else composed([row_step(k) for k in text])
        known = [t for t in turns if t is not None]
        done.append(
            (
                key[1], key[0], first, text, _flat(step[0]), _flat(step[1]),
                faults.count("b"), faults.count("d"), faults.count("t"),
                sum(p not in LAWFUL for p in zip(roles, roles[1:])), roles[0], roles[-1],
                min(known, default=None), max(known, default=None), len(set(known)),
            )
        )

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*done), schema.types)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("pos", "conv_id", "turn", "initial", "kind", "fault"))
        for pos, conv, turn, role, kind, fault in zip(*columns):
            now = (pos >> bits, conv)
            if now != key:
                if key is not None:
                    close()
                key, kinds, roles, turns, faults, first = now, [], [], [], [], pos
            kinds.append(kind)
            roles.append(role)
            turns.append(turn)
            faults.append(fault)
        if len(done) >= 4096:
            yield out()
    if key is not None:
        close()
    if done:
        yield out()


def _joined(rows: pa.Table) -> pa.Table:
    """Steps of one run, in order, as one."""
    rows = rows.sort_by("id")
    step = composed([_step(c, r) for c, r in zip(rows.column("costs").to_pylist(), rows.column("ranks").to_pylist())])
    return pa.table(
        {
            "conv_id": rows.column("conv_id").slice(0, 1),
            "id": rows.column("up").slice(0, 1),
            "costs": pa.array([_flat(step[0])], pa.list_(pa.int64())),
            "ranks": pa.array([_flat(step[1])], pa.list_(pa.int64())),
        }
    )


def _parted(rows: pa.Table) -> pa.Table:
    """The states at the ends of each step of one run, from those at the ends of the run."""
    rows = rows.sort_by("id")
    steps = [_step(c, r) for c, r in zip(rows.column("costs").to_pylist(), rows.column("ranks").to_pylist())]
    end = rows.column("end")[0].as_py()
    before = crossings(steps, rows.column("start")[0].as_py(), end)
    return pa.table(
        {
            "conv_id": rows.column("conv_id"),
            "id": rows.column("id"),
            "start": pa.array(before, pa.int64()),
            "end": pa.array([*before[1:], end], pa.int64()),
        }
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and last state of each conversation, from its one step."""
    for batch in rows_of(batches, 4096):
        found = [best_end(_step(c, r)) for c, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        columns = [pa.array(x, pa.int64()) for x in ([c for c, _ in found], [0] * len(found), [e for _, e in found])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv_id", "id", "cost", "start", "end"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every row of each segment."""
    for batch in rows_of(batches, 512):
        conv, seg, first, kinds, start, end = (c.to_pylist() for c in batch.columns)
        edits = [_short(k, s, e) if len(k) <= 64 else _edits(k, s, e) for k, s, e in zip(kinds, start, end)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(conv, pa.int64()), pa.array(seg, pa.int64()), pa.array(first, pa.int64()),
                pa.array(edits, pa.list_(pa.string())),
                pa.array(["".join(x.partition(":")[0] for x in e) for e in edits], pa.string()),
            ],
            ["conv_id", "seg", "first_pos", "edits", "audit"],
        )


def _at(*names: str) -> Column:
    return place(list(names))


def _ends(segments: DataFrame, tier_bits: int = TIER_BITS) -> DataFrame:
    """(conv_id, seg, start, end, cost): the states at the ends of every segment; cost and last state of its conversation.

    Runs of segments are joined tier by tier until a conversation is one step; from its ends the states
    travel back down. A task holds one run. Conversations within one segment skip the tiers.
    """
    per = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = segments.withColumn("_at", _at("conv_id")).join(
        per.select(_at("conv_id").alias("_at"), "_n"), "_at"
    ).drop("_at")
    nodes = materialise(counted.select("conv_id", F.col("seg").alias("id"), "costs", "ranks", "_n"), "segment_steps")
    step, state = "conv_id long, id long, costs array<long>, ranks array<long>", "conv_id long, id long, start long, end long"
    single = nodes.filter("_n = 1").select("conv_id", "id", "costs", "ranks")
    whole = "conv_id long, id long, cost long, start long, end long"
    lone = single.mapInArrow(_whole, whole).select("conv_id", F.col("id").alias("seg"), "start", "end", "cost", F.col("end").alias("last"))
    tiers = [nodes.filter("_n > 1").select("conv_id", "id", "costs", "ranks")]
    if tiers[0].isEmpty():
        return lone
    while not tiers[-1].groupBy("conv_id").count().filter("count > 1").isEmpty():
        above = tiers[-1].withColumn("up", F.shiftright("id", tier_bits)).groupBy("conv_id", "up").applyInArrow(_joined, step)
        tiers.append(materialise(above, "steps"))
    tops = materialise(tiers[-1].mapInArrow(_whole, whole), "tops")
    now = tops.select("conv_id", "id", "start", "end")
    for tier in reversed(tiers[:-1]):
        keyed = tier.withColumn("up", F.shiftright("id", tier_bits))
        run = now.select(F.struct("conv_id", F.col("id").alias("up")).alias("_at"), "start", "end")
        met = keyed.withColumn("_at", F.struct("conv_id", "up")).join(run, "_at").drop("_at")
        now = materialise(met.groupBy("conv_id", "up").applyInArrow(_parted, state), "states")
    told = tops.select(_at("conv_id").alias("_at"), "cost", F.col("end").alias("last"))
    many = now.withColumn("_at", _at("conv_id")).join(told, "_at")
    return lone.union(many.select("conv_id", F.col("id").alias("seg"), "start", "end", "cost", "last"))


def _faults(turns: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, initial, kind, fault) of every row; the first place of each role and text is not a duplicate."""
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_new"))
    rows = turns.select("pos", "conv_id", "turn", "initial", "blank", "broken").join(firsts, "pos", "left")
    fault = (
        F.when(F.col("blank"), "b").when(F.col("_new").isNull(), "d").when(F.col("broken"), "t").otherwise("")
    )
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    rows = rows.withColumn("fault", fault)
    return rows.select(
        "pos",
        "conv_id",
        "turn",
        "initial",
        F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(kind)).otherwise(kind).alias("kind"),
        "fault",
    )


def _facts(segments: DataFrame) -> DataFrame:
    """Gaps and counts of faults of each conversation, with the pairs that two segments share."""
    last = Window.partitionBy("conv_id").orderBy("seg")
    role, turn = F.lag("last_role").over(last), F.lag("max_turn").over(last)
    pair = F.concat_ws("|", role, "first_role")
    rows = segments.withColumns(
        {
            "_seam": F.when(role.isNotNull() & ~pair.isin("s|u", "u|a", "a|u"), 1).otherwise(0),
            "_same": F.when(turn == F.col("min_turn"), 1).otherwise(0),
        }
    )
    found = rows.groupBy("conv_id").agg(
        F.coalesce(
            F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns") + F.sum("_same"), F.lit(0)
        ).alias("gaps"),
        F.sum("n_blank").alias("blank"),
        F.sum("n_duplicate").alias("duplicate"),
        F.sum("n_truncated").alias("truncated"),
        (F.sum("n_illegal") + F.sum("_seam")).alias("illegal"),
    )
    return found


class Repair:
    """Outcome of ``repair``: ``rows``, the repaired turns, and ``summary``, one row per conversation."""

    def __init__(self, rows: DataFrame, summary: DataFrame):
        self.rows, self.summary = rows, summary


def repair(turns: DataFrame, segment_bits: int = SEGMENT_BITS, tier_bits: int = TIER_BITS) -> Repair:
    """Cheapest edits that make every conversation alternate.

    ``turns`` (conv_id, turn, role, text), other columns are not looked at. Rows are taken by turn (missing first), ties
    by role, then by the text's hash. A missing role or text counts as one space. Blank rows
    and later copies of a row are deleted (4); a row may get another role (3); an empty
    user or assistant turn may be inserted anywhere (3); a row that breaks off and stays adds 3.

    ``rows`` (conv_id, pos, part, role, text), in order of pos, part. ``summary``: ``gaps`` in the turn numbers, the counts ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, the ``cost`` and the ``audit`` (K, R, D, I in order; the first in ASCII
    order among equal costs). Rows without a conversation id are one conversation. Repeated rows are duplicates. Very
    long texts are sorted by their hash and travel whole; an empty table gives empty results.

    The table is sorted once over all ranges; segments are 2 ** ``segment_bits`` places in it, so a conversation of any
    length is spread over many tasks and solved from the steps of its segments, 2 ** ``tier_bits`` at a time.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("broken"),
        "text",
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    kept = in_order(rows, *order, name="turns")
    steps = _faults(kept).repartition(F.shiftright("pos", segment_bits)).sortWithinPartitions("pos")
    segments = materialise(steps.mapInArrow(lambda batches: _segments(batches, segment_bits), SEGMENT), "segments")
    ends = materialise(_ends(segments, tier_bits), "segment_ends")
    at = F.struct("conv_id", "seg")
    open_ = segments.withColumn("_at", at).join(ends.withColumn("_at", at).select("_at", "start", "end"), "_at")
    solved = materialise(
        open_.select("conv_id", "seg", "first_pos", "kinds", "start", "end").mapInArrow(
            _solved, "conv_id long, seg long, first_pos long, edits array<string>, audit string"
        ),
        "edits",
    )
    tail = F.when(F.col("last") == 1, "II").when(F.col("last") == 2, "I").otherwise("")
    audits = (
        solved.groupBy("conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        .select(_at("conv_id").alias("_at"), "audit")
    )
    costs = ends.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("last").alias("last")).select(
        _at("conv_id").alias("_at"), "cost", "last"
    )
    summary = (
        _facts(segments)
        .withColumn("_at", _at("conv_id"))
        .join(costs, "_at")
        .join(audits, "_at")
        .select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
            F.concat("audit", tail).alias("audit"), "last",
        )
    )
    summary = materialise(summary, "repairs")
    own = F.get("edits", (F.col("pos") - F.col("first_pos")).cast("int"))
    met = (
        kept.select("conv_id", "pos", "role", "text", F.shiftright("pos", segment_bits).alias("seg"))
        .withColumn("_at", at)
        .join(solved.withColumn("_at", at).select("_at", "first_pos", "edits"), "_at")
        .withColumn("_edit", own)
    )
    edit, letters = F.substring_index("_edit", ":", 1), F.substring_index("_edit", ":", -1)
    name = F.expr("transform(filter(split(substring_index(_edit, ':', -1), ''), x -> x <> ''), x -> if(x = 'u', 'user', 'assistant'))")
    met = met.select("conv_id", "pos", "role", "text", edit.alias("edit"), letters.alias("letters"), name.alias("names"))
    inserted = F.expr("slice(names, 1, length(edit) - 1)")
    empty = F.transform(inserted, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    kept_role = F.when(F.col("edit").endswith("R"), F.element_at("names", -1)).otherwise(F.col("role"))
    none = F.expr("cast(array() AS array<struct<role:string,text:string>>)")
    itself = F.when(F.col("edit").endswith("D"), none).otherwise(F.array(F.struct(kept_role.alias("role"), "text")))
    body = met.select("conv_id", "pos", F.posexplode(F.concat(empty, itself)).alias("part", "_row"))
    # after the system turn a user and an assistant are missing, after a user only the assistant
    ends_with = F.when(F.col("last") == 1, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("last") == 2, F.array(F.lit("assistant")))
    last = summary.filter("last in (1, 2)").select(
        "conv_id", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(ends_with).alias("part", "role"), F.lit("").alias("text")
    )
    return Repair(body.select("conv_id", "pos", "part", "_row.role", "_row.text").union(last), summary.drop("last"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation; rows come in order, and only the hash is held."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k for (k,), _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"]
        )
        done.clear()
        return batch

    for batch in rows_of(batches):
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (conv,) != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = (conv,), hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        if len(done) >= 4096:
            yield out()
    if key is not None:
        done.append((key, state.hexdigest()))
    if done:
        yield out()


def conversation_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each conversation, in order.

    One hash cannot be split, so a conversation streams through one task, sorted and spilled by Spark; only
    the hash's state is held there.
    """
    line = F.concat("role", F.lit(":"), "text")
    ordered = rows.select("conv_id", line.alias("line"), "pos", "part").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "pos", "part").select("conv_id", "line")
    return ordered.mapInArrow(_hashed, "conv_id long, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, by CRC-32 of ``conv_id:turn`` (missing ones as a space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user turn.
    """

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), hit.alias("_hit"))
    return rows.filter("_hit <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_hit") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


# --- the same in SQL: four states with cost, audit and lines, row after row ---


def _way(state: str, cost: str, edit: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'p': {state}.p || '{edit}', 't': {state}.t || {line}}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _repair_sql() -> str:
    user, assistant, line = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    added = {
        "t0": "s0",
        "t1": "s1",
        "t2": _least("s2", *[_way(s, "3", "I", user) for s in ("s0", "s1", "s3")]),
        "t3": _least("s3", _way("s2", "3", "I", assistant), *[_way(s, "6", "II", f"{user} || {assistant}") for s in ("s0", "s1")]),
    }

    def kept(state: str, role: str) -> str:
        return _way(state, f"CASE WHEN kind = '{role}' THEN cut ELSE 1000000 END", "K", line)

    def given(state: str, role: str) -> str:
        return _way(state, "CASE WHEN kind = 'x' THEN 1000000 ELSE 3 + cut END", "R", f"chr(10) || '{role}:' || text")

    ways = {
        "s0": [_way("t0", "4", "D")],
        "s1": [_way("t1", "4", "D"), kept("t0", "s")],
        "s2": [_way("t2", "4", "D")] + [f(t, r) for t in ("t0", "t1", "t3") for f, r in ((kept, "u"), (given, "user"))],
        "s3": [_way("t3", "4", "D"), kept("t2", "a"), given("t2", "assistant")],
    }
    far = "{'c': 1000000, 'p': '', 't': ''}"
    return f"""WITH RECURSIVE hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
copies AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hits WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS head FROM copies),
judged AS (SELECT *, head = '' AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen,
    right(head, 1) NOT IN ('.', '!', '?') AS broken,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY rn), 1) || '|' || left(role, 1) AS pair FROM placed),
faulty AS (SELECT *, CASE WHEN blank OR seen THEN 'x' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind,
    CASE WHEN broken THEN 3 ELSE 0 END AS cut FROM judged),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, {{'c': 0, 'p': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM faulty
  UNION ALL
  SELECT conv_id, rn, {', '.join(f"{_least(*w)} AS {s}" for s, w in ways.items())}
  FROM (SELECT w.conv_id, f.rn, f.kind, f.cut, f.role, f.text, {', '.join(f'{w} AS {t}' for t, w in added.items())}
    FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = w.rn + 1)),
ends AS (SELECT conv_id, {_least("s0", "s3", _way("s1", "6", "II", f"{user} || {assistant}"), _way("s2", "3", "I", assistant))} AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT blank AND NOT seen AND broken) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('s|u', 'u|a', 'a|u')) AS illegal FROM faulty GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in FACTS)},
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.p, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f ON i.conv_id IS NOT DISTINCT FROM f.conv_id
  LEFT JOIN ends e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


@query("op13_conversations", _repair_sql())
def op13(spark, sf):
    turns = table(spark, sf, "conversations")
    done = repair(damaged(turns))
    at = _at("conv_id").alias("_at")
    ids = turns.select(F.col("conv_id").cast("long")).distinct().select("conv_id", at)
    found = done.summary.select(at, *FACTS, "cost", "audit")
    hashes = conversation_hashes(done.rows).select(at, "sha256")
    return (
        ids.join(found, "_at", "left")
        .join(hashes, "_at", "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*FACTS, "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"),
        )
    )
