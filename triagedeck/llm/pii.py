"""Personal data: exact base spans, and candidates that calibrated boosted trees accept."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4000  # documents whose candidates the trees are fitted on, at most
SAMPLE_ROWS = 40_000  # of these candidates, at most
TREES, DEPTH, SHRINK, CUTS, LEAST = 40, 3, 0.3, 24, 8
PRECISION = 0.99  # wanted of accepted candidates among held-out ones
CONTEXT = 40  # code points on each side
SCORED = 5000  # candidates of a text that are judged together
Span = tuple[str, int, int]

# The base forms. Runs start where no digit precedes, which no match can miss.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
# The generators of looser forms.
AT = re.compile(r"@|[(\[]at[)\]]| at ", re.I)
BEFORE_AT = re.compile(r"[\w.+%-]{1,64} ?$")
AFTER_AT = re.compile(r" ?[\w-]{1,64}(?: ?(?:\.|[(\[]dot[)\]]|\bdot\b) ?[\w-]{1,64}){1,6}", re.I)
RUN = re.compile(r"[0-9]++(?:[ ().\-/]*+[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]| \. |,)[0-9]{1,3}){3}(?![0-9])")
HEXES = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7}(?![0-9A-Fa-f:])")
CUES = {
    "email": re.compile(r"mail|contact|write to", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping valid matches of each kind, by kind, then start; linear in the text."""
    out: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def windows(text: str, start: int, end: int) -> Iterator[Span]:
    """All neighbouring digit groups of a run, of any length, that together have the digits of a
    phone or a card; a plus sign or bracket before the first belongs to them."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    for i, (first, _) in enumerate(groups):
        n, at = 0, first - (text[first - 1 : first] == "(")
        at -= text[at - 1 : at] == "+"
        for a, b in groups[i:]:
            n += b - a
            if n > 19:
                break
            if 7 <= n <= 15:
                yield "phone", at, b
            if n >= 13:
                yield "card", at, b


def apart(spans: list[Span], others: Iterable[Span]) -> list[Span]:
    """The spans that overlap none of the others."""
    ends: list[int] = []
    starts: list[int] = []
    for _, a, b in sorted(others, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in spans if (k := bisect_left(starts, s[2])) == 0 or ends[k - 1] <= s[1]]


def candidates(text: str) -> list[Span]:
    """Overlapping spans that might be personal data, for the trees to judge."""
    out: list[Span] = []
    for m in AT.finditer(text):
        before = BEFORE_AT.search(text, max(0, m.start() - 66), m.start())
        after = AFTER_AT.match(text, m.end())
        if before and after:
            out.append(("email", before.start(), after.end()))
    for m in RUN.finditer(text):
        out += windows(text, *m.span())
    out += [("ip", *m.span()) for r in (QUAD, HEXES) for m in r.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    kind, start, end = span
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    digits = NOT_DIGIT.sub("", s)
    marks = re.findall(r"[^0-9A-Za-z]", s)
    parts = [int(g) for g in re.findall(r"[0-9]{1,4}", s)] or [0]

    def side(c: str) -> float:
        return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0

    return [
        float(KINDS.index(kind)),
        len(s),
        len(digits),
        len(digits) / len(s),
        len(marks),
        len(set(marks)),
        len(groups),
        max(groups),
        min(groups),
        float(np.std(groups)),
        groups[-1],
        float(s[:1] == "+"),
        float("(" in s),
        float(luhn(digits)) if digits else 0.0,
        float(max(parts)),
        float("@" in s),
        float(bool(re.search(r"[(\[]at[)\]]", s, re.I))),
        float(" at " in s.lower()),
        float(bool(re.search(r"\bdot\b|[(\[]dot", s, re.I))),
        float(len(re.split(r"[^A-Za-z]+", s)[-1])),
        sum(c.isupper() for c in s) / len(s),
        float(":" in s),
        side(before[-1:]),
        side(after[:1]),
        sum(c.isdigit() for c in before) / CONTEXT,
        sum(c.isdigit() for c in after) / CONTEXT,
        float(bool(CUES[kind].search(before))),
        float(any(CUES[k].search(before) for k in KINDS if k != kind)),
    ]


def variant(kind: str, s: str, rng: random.Random) -> str:
    """The same datum as people write it to escape simple patterns."""
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("@", "(dot)")])
        local, _, domain = s.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", " . "]))
    digits = NOT_DIGIT.sub("", s)
    if kind == "card":
        mark = rng.choice([".", "/"])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}"])


def decoy(rng: random.Random) -> str:
    """Digits and words that only look like personal data."""
    r = rng.randrange
    return rng.choice(
        [
            f"{1900 + r(200)}-{1 + r(12):02}-{1 + r(28):02} {r(24):02}.{r(60):02}",
            f"{r(10)}.{r(10**9):09}",
            f"{r(10**6)} {r(10**6)} {r(10**6)}",
            f"{300 + r(600)}.{300 + r(600)}.{r(999)}.{r(999)}",
            f"{r(10**16):016}",
            f"{r(10**9):09}",
            f"{r(9999)}/{r(9999)}/{r(9999)}",
            "look at the end. Then",
            "arrive at noon. We",
            f"{r(99)}, {r(99)}, {r(99)}, {r(99)}",
        ]
    )


def neighbour(rng: random.Random) -> str:
    """A number that may stand beside another one."""
    r = rng.randrange
    return rng.choice([f"{r(10**16):016}", ".".join(str(r(256)) for _ in range(4)), f"+1 {200 + r(800)} {200 + r(800)} {r(10**4):04}"])


def checked(text: str, span: Span) -> bool:
    """Whether a candidate passes a check of its kind, so that it may well be personal data."""
    kind, start, end = span
    if kind == "card":
        return luhn(NOT_DIGIT.sub("", text[start:end]))
    return kind == "phone" and text[start] == "+"


def examples(text: str, key: str) -> tuple[list[list[float]], list[int]]:
    """Weakly labelled candidates: base spans, variants of them, and both beside another number are
    personal data in their context; parts of them, decoys, and other candidates without a check are not."""
    rng = random.Random(key)
    base = base_spans(text)
    x, y = [], []
    for kind, start, end in base:
        own = text[start:end]
        forms = [(own, 1, "", ""), (variant(kind, own, rng), 1, "", ""), (decoy(rng), 0, "", "")]
        if kind in ("card", "phone"):
            number = neighbour(rng)
            forms.append((own, 1, *rng.choice([("", " " + number), (number + " ", "")])))
        for s, label, left, right in forms:
            around = text[max(0, start - 200) : start] + left + s + right + text[end : end + 200]
            at = min(start, 200) + len(left)
            hits = [c for c in candidates(around) if c[1] < at + len(s) and at < c[2]]
            for c in hits:
                whole = c[0] == kind and c[1] <= at and c[2] >= at + len(s) - 1
                if label and c[0] == kind and not whole and kind not in ("card", "phone"):
                    continue
                x.append(features(around, c))
                y.append(int(label and whole and c[2] - c[1] <= len(s) + 2))
    for c in apart(candidates(text), base):
        if not checked(text, c):
            x.append(features(text, c))
            y.append(0)
    return x, y


def _tree(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> dict[str, np.ndarray]:
    """A complete tree of DEPTH levels by the best gain of each node."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, limit = np.zeros(inner, int), np.full(inner, np.inf)
    node = np.zeros(len(x), int)
    for k in range(inner):
        here = np.flatnonzero(node == k)
        g, h, best = grad[here], hess[here], 1e-6
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            right = x[here, f][:, None] > cuts[f][None, :]
            n, gr, hr = right.sum(axis=0), g @ right, h @ right
            gain = gr**2 / (hr + 1) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1) - whole
            gain[(n < LEAST) | (len(here) - n < LEAST)] = 0
            if len(gain) and gain.max() > best:
                best, feature[k], limit[k] = gain.max(), f, cuts[f][gain.argmax()]
        node[here] = 2 * k + 1 + (x[here, feature[k]] > limit[k])
    at = node - inner
    value = -SHRINK * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + 1)
    return {"feature": feature, "limit": limit, "value": value}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for t in model["trees"]:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, t["feature"][node]] > t["limit"][node])
        out += t["value"][node - (2**DEPTH - 1)]
    return out


def chance(model: dict, x: np.ndarray) -> np.ndarray:
    a, b = model["scale"]
    return 1 / (1 + np.exp(-np.clip(a * margin(model, x) + b, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict | None:
    """Boosted trees on two thirds; on the last third a logistic scale, and per kind the lowest
    threshold (never below a half) from which on the wanted precision holds. Without both labels: None, which accepts nothing."""
    held = np.arange(len(y)) % 3 == 2
    tx, ty = x[~held], y[~held]
    if len(set(ty.tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    share = ty.mean()
    model = {"start": float(np.log(share / (1 - share))), "trees": [], "scale": (1.0, 0.0)}
    cuts = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, CUTS + 1)[:-1])) for f in range(x.shape[1])]
    now = np.full(len(ty), model["start"])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-now))
        model["trees"].append(_tree(tx, cuts, p - ty, p * (1 - p)))
        now = margin(model, tx)
    m, a, b = margin(model, x[held]), 1.0, 0.0
    for _ in range(200):
        d = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) - y[held]
        a, b = a - 0.05 * ((d * m).mean() + 0.01 * (a - 1)), b - 0.05 * d.mean()
    model["scale"] = (a, b)
    p, kind = chance(model, x[held]), x[held][:, 0]
    model["limits"] = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-p[own], kind="stable")]
        good = np.cumsum(y[held][own]) / np.arange(1, len(own) + 1) >= precision
        ok = [p[own[i]] for i in np.flatnonzero(good)]
        model["limits"].append(max(0.5, min(ok)) if ok else 2.0)
    return model


def all_spans(text: str, model: dict | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and accepted spans), each by kind, then start."""
    base = base_spans(text)
    if model is None:
        return base, base
    loose = apart(candidates(text), base)
    ranked: list[tuple[float, int]] = []
    for at in range(0, len(loose), SCORED):
        p = chance(model, np.array([features(text, c) for c in loose[at : at + SCORED]], np.float64))
        ranked += [(-v, at + i) for i, v in enumerate(p) if v >= model["limits"][KINDS.index(loose[at + i][0])]]
    taken: list[Span] = []
    at_start: list[tuple[int, int]] = []  # of the taken spans, which are apart
    for _, i in sorted(ranked):
        _, start, end = loose[i]
        k = bisect_left(at_start, (end,))
        if k == 0 or at_start[k - 1][1] <= start:
            taken.append(loose[i])
            insort(at_start, (start, end))
    return base, sorted(base + taken, key=lambda s: (KINDS.index(s[0]), s[1]))


def named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with the name of its kind in the place of every span; overlapping ones are one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = [], []
        for text in batch.column(0).to_pylist():
            key = hashlib.md5((text or "").encode()).hexdigest()
            for row, label in zip(*examples(text or "", key)):
                x.append([float(v) for v in row])
                y.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])


def pii_model(
    docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS
) -> dict | None:
    """Trees fitted on the candidates of the first documents in a hash order, within both bounds."""
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    hashed = texts.withColumn("_h", F.xxhash64("text"))
    last = hashed.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    if last is None:
        return None
    sample = hashed.filter(F.col("_h") <= last).select("text").limit(sample_docs)
    rows = (
        sample.mapInArrow(_examples, "x array<double>, y int")
        .orderBy(F.xxhash64("x"), "y")
        .limit(sample_rows)
        .collect()
    )
    if not rows:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def _find(model: dict | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, names, texts = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base, spans = all_spans(text, model)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                names.append(named(spans))
                texts.append(redacted(text, spans))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"],
            )

    return find


def find_pii(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans``, ``redacted``.

    Every whole text is searched for the base forms, which always stay, and for looser candidates,
    which are added where the trees' calibrated chance reaches the threshold of their kind;
    of overlapping ones the likeliest is added, and none that overlaps a base span.
    Missing texts are empty; every row returns; without a model only base spans are found.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_find(model), f"doc_id long, {counts}, base_sha256 string, spans string, redacted string")


@query("op1_pii")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return find_pii(docs, pii_model(docs)).drop("redacted")
