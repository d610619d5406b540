"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from triagedeck.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, seg string, cost int, audit int, pos int"
SPACES = " \t\n\x0b\x0c\r"


def turns():
    rng = random.Random(5)
    out = []
    for conv in [None, *range(1, 60)]:
        n = 400 if conv == 9 else rng.randint(0, 9)
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine. ", "Why?\n", "cut off", "", " \t", None, f"Turn {t}!", "Same.", "Ä ö."])
            turn = None if rng.random() < 0.05 else t + (t > 5)
            out.append((conv, turn, role, text, "x", 1, 2, 3))
    out += [(70, 0, "user", "long " * 200000, "x", 1, 2, 3), (70, 0, "user", "long " * 200000, "x", 1, 2, 3)]
    return out


def harm(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else text.translate({ord(x): None for x in ".!?"}) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def solve(rows):
    """Least (cost, audit) by trying every edit, and the repaired lines."""

    @lru_cache(maxsize=None)
    def best(at, state, inserts):
        ways = [(0, "", ())] if at == len(rows) and state in (0, 3) else []
        follow = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name = {2: "user", 3: "assistant"}[follow]

        def add(cost, edit, line, where):
            more = best(*where)
            if more:
                ways.append((cost + more[0], edit + more[1], line + more[2]))

        if inserts < 3:
            add(3, "I", (f"{name}:",), (at, follow, inserts + 1))
        if at < len(rows):
            role, text, fault = rows[at]
            add(4, "D", (), (at + 1, state, 0))
            if fault not in ("b", "d"):
                cut = 3 * (fault == "t")
                add(3 + cut, "R", (f"{name}:{text}",), (at + 1, follow, 0))
                if state == 0 and role[:1] == "s":
                    add(cut, "K", (f"{role}:{text}",), (at + 1, 1, 0))
                if role[:1] == name[0]:
                    add(cut, "K", (f"{role}:{text}",), (at + 1, follow, 0))
        return min(ways, key=lambda w: w[:2]) if ways else None

    for k in range(len(rows), -1, -40):
        for state in range(4):
            best(max(k, 0), state, 0)
    return best(0, 0, 0)


def expected(rows):
    out = []
    harmed = harm(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in harmed if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in own:
            end = text.strip(SPACES)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        known = [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + "|" + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = solve(tuple(judged))
        faults = [j[2] for j in judged]
        out.append(
            (
                str(conv),
                max(known) - min(known) + 1 - len(set(known)) if known else 0,
                faults.count("b"), faults.count("d"), faults.count("t"),
                sum(p not in ("s|u", "u|a", "a|u") for p in pairs),
                cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            )
        )
    return sorted(out)


@pytest.mark.parametrize("bits", [(12, 10), (3, 2)])
def test_repair(spark, bits):
    docs = spark.createDataFrame(turns(), SCHEMA).repartition(5)
    done = c.repair(c.damaged(docs), *bits)
    found = {str(r.conv_id): r for r in done.summary.collect()}
    hashes = {str(r.conv_id): r.sha256 for r in c.conversation_hashes(done.rows).collect()}
    for conv, *want in expected(turns()):
        r = found.get(conv)
        got = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) if r else (0, 0, 0, 0, 0, 0, "")
        assert [*got, hashes.get(conv, c.EMPTY_HASH)] == want, conv


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [*turns(), (88, 4, "user", "x", "x", 1, 2, 3)]
    rows += [(99, t, "user", "Gone.", "x", 1, 2, 3) for t in range(200) if zlib.crc32(f"99:{t}".encode()) % 20 == 0]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = c.op13(spark, str(tmp_path)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((str(r.conv_id), *[r[n] for n in names]) for r in got) == expected(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = c.repair(c.damaged(none))
    assert done.summary.count() == 0 and done.rows.count() == 0


def test_halves_meet_as_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 30)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(k.lower(), "tool"), "t", "b" if k == "x" else "t" if k.isupper() else "") for k in kinds]
        cost, end = c.best_end(c.composed([c.row_step(k) for k in kinds]))
        audit = "".join(e.partition(":")[0] for e in c._edits(kinds, 0, end)) + "I" * c.TAIL[end]
        assert (cost, audit) == solve(tuple(rows))[:2]
