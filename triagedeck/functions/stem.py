"""Porter's suffix stripping (Porter 1980): column expressions over token arrays, and the same in plain Python.

The expressions are what tables use. ``porter`` states the rules for one token and is what the tests
compare them with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, step by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One letter per character: c consonant, v vowel."""
    kinds: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and kinds and kinds[-1] == "c")
        kinds.append("v" if vowel else "c")
    return "".join(kinds)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-2:] == "cc"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or not _has_vowel(word[: -len(end)]):
        return word
    stem = word[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def _mapped(word: str, rules: dict[str, str]) -> str:
    end = _longest(word, rules)
    if end is not None and _measure(word[: -len(end)]) > 0:
        return word[: -len(end)] + rules[end]
    return word


def _residue(word: str) -> str:
    end = _longest(word, STEP_4)
    if end is None:
        return word
    stem = word[: -len(end)]
    if _measure(stem) < 2 or (end == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter(token: str) -> str:
    """Stem of one token, in lower case; one- and two-letter tokens stay as they are."""
    word = token.lower()
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(word, STEP_2)
    word = _mapped(word, STEP_3)
    return _tidy(_residue(word))


# The forms of the description as patterns: c a consonant, v a vowel, "Y" a y that begins the token and is a
# consonant there. Any other y is a vowel after a consonant and a consonant after a vowel, which is
# how the patterns read it from left to right. Stars repeat single characters only, so
# a token of any length needs no stack.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_1 = f"^(?:{_C})?{_V}[^aeiou]"  # m > 0
MEASURE_2 = f"^(?:{_C})?{_V}{_C}{_V}[^aeiou]"  # m > 1
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]\\z"  # m = 1 and *o


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _plural_c(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .otherwise(w)
    )


def _past_end_c(w: Column) -> Column:
    """The word without its ending, and whether that ending asks for a repair of the stem."""
    eed, vowel = w.endswith("eed"), "[aeiouy]"
    ed = ~eed & w.endswith("ed") & _cut(w, 2).rlike(vowel)
    ing = w.endswith("ing") & _cut(w, 3).rlike(vowel)
    stem = F.when(eed & _cut(w, 3).rlike(MEASURE_1), _cut(w, 1)).when(ed, _cut(w, 2)).when(ing, _cut(w, 3))
    return F.struct(stem.otherwise(w).alias("stem"), (ed | ing).alias("open"))


def _past_repair_c(p: Column) -> Column:
    w = p["stem"]
    last = F.right(w, F.lit(1))
    double = last.rlike("[^aeiouylsz]") & (F.right(w, F.lit(2)) == F.concat(last, last))
    return (
        F.when(~p["open"], w)
        .when(w.rlike("(?:at|bl|iz)\\z") | w.rlike(SHORT_END), F.concat(w, F.lit("e")))
        .when(double, _cut(w, 1))
        .otherwise(w)
    )


def _last_y_c(w: Column) -> Column:
    turn = w.endswith("y") & _cut(w, 1).rlike("[aeiouy]")
    return F.when(turn, F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _longest_c(suffixes: Iterable[str]) -> Callable[[Column], Column]:
    """The word beside the longest of the suffixes it ends in (empty: none)."""
    by_length = sorted(suffixes, key=len)

    def step(w: Column) -> Column:
        end = F.lit("")
        for suffix in by_length:
            end = F.when(w.endswith(suffix), F.lit(suffix)).otherwise(end)
        return F.struct(w.alias("word"), end.alias("end"))

    return step


def _mapped_c(rules: dict[str, str]) -> Callable[[Column], Column]:
    def step(p: Column) -> Column:
        stem, new = F.left(p["word"], F.length(p["word"]) - F.length(p["end"])), F.lit("")
        for end, put in rules.items():
            new = F.when(p["end"] == end, F.lit(put)).otherwise(new) if put else new
        hit = (p["end"] != "") & stem.rlike(MEASURE_1)
        return F.when(hit, F.concat(stem, new)).otherwise(p["word"])

    return step


def _residue_c(p: Column) -> Column:
    stem = F.left(p["word"], F.length(p["word"]) - F.length(p["end"]))
    hit = (p["end"] != "") & ((p["end"] != "ion") | stem.rlike("[st]\\z")) & stem.rlike(MEASURE_2)
    return F.when(hit, stem).otherwise(p["word"])


def _last_e_c(w: Column) -> Column:
    stem = _cut(w, 1)
    drop = stem.rlike(MEASURE_2) | (stem.rlike(MEASURE_1) & ~stem.rlike(SHORT_END))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _last_l_c(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_2), _cut(w, 1)).otherwise(w)


def stem_tokens(tokens: Column | str) -> Column:
    """Stem every token of an array; null arrays and null tokens stay null.

    Each step is a ``transform`` of its own: what a step uses several times is computed once, and
    the expression grows with the number of rules only. No shuffle and no Python worker.
    """
    given = F.col(tokens) if isinstance(tokens, str) else tokens
    words = F.transform(given, lambda t: F.lower(t))
    words = F.transform(words, lambda w: F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, 2, 1 << 30))).otherwise(w))
    for step in (
        _plural_c, _past_end_c, _past_repair_c, _last_y_c, _longest_c(STEP_2), _mapped_c(STEP_2),
        _longest_c(STEP_3), _mapped_c(STEP_3), _longest_c(STEP_4), _residue_c, _last_e_c, _last_l_c,
    ):
        words = F.transform(words, step)
    return F.zip_with(
        given, words, lambda t, w: F.when(F.length(F.lower(t)) <= 2, F.lower(t)).otherwise(F.lower(w))
    )
