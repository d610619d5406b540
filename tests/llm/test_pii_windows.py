"""Numbers that stand side by side, of which a greedy run sees only the whole."""

import hashlib
import random

import numpy as np
import pytest

from triagedeck.llm import pii

WORDS = "the cat sat on a mat by our door and saw ten red birds fly over it".split()


def card(rng):
    body = f"4{rng.randrange(10**14):014}"
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    x, y = [], []
    for i in range(400):
        datum = [card(rng), f"+1 ({200 + i}) 555-{1000 + i}"][i % 2]
        around = [" ".join(rng.choices(WORDS, k=rng.randrange(3, 12))) for _ in range(2)]
        text = f"{around[0]} {datum} {around[1]} {i} {10**6 + 7 * i}"
        rows, labels = pii.examples(text, hashlib.md5(text.encode()).hexdigest())
        x += rows
        y += labels
    return pii.fit(np.array(x), np.array(y))


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("paid with 7536784127813050 4845168114407329 today", ["7536784127813050", "4845168114407329"]),
        ("so call +1 (826) 555-4081 190.137.223.204 now", ["190.137.223.204", "+1 (826) 555-4081"]),
    ],
)
def test_side_by_side(model, text, wanted):
    assert sorted(text[a:b] for _, a, b in pii.all_spans(text, model)[1]) == sorted(wanted)


def test_windows_of_a_long_run():
    """Every window of groups with 13 to 19 digits, however long the run is."""
    text = " ".join(f"{n:04}" for n in range(100))
    got = [c for c in pii.candidates(text) if c[0] == "card"]
    assert got == [("card", 5 * i, 5 * i + 19) for i in range(97)]


def test_apart_equals_all_pairs():
    rng = random.Random(0)
    for _ in range(200):
        spans, others = ([("ip", a, a + 1 + rng.randrange(9)) for a in rng.choices(range(60), k=12)] for _ in range(2))
        others = others[: rng.randrange(13)]
        want = [s for s in spans if not any(o[1] < s[2] and s[1] < o[2] for o in others)]
        assert pii.apart(spans, others) == want


def test_a_natural_card_is_no_weak_negative():
    text = "7536784127813050 4845168114407329"
    x, _ = pii.examples(text, "k")
    assert pii.base_spans(text) == []
    assert not [r for r in x if r[0] == pii.KINDS.index("card") and r[13] == 1.0]
