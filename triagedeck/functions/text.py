"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacement words the cleaning rules are defined by.
URL_PATTERN = r"(?U)http\S+"
URL_WORD = "URL"
FENCE_PATTERN = r"(?s)```.*?```"
FENCE_WORD = "CODE"
SPAN_PATTERN = r"`[^`]+`"
ANY_MARK = r"(?U)\S"
EDGE_SPACE = r"(?U)^\s+|\s+$"
# Words, or single marks other than letters, digits, underscore and white space.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Vocabulary terms: at least two word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# What an answer says, in any case: severe, and the same word denied.
SEVERE_ANSWER = "[sS][eE][vV][eE][rR][eE]"
DENIED_ANSWER = "[nN][oO][tT] *" + SEVERE_ANSWER
# The usual English stop-word list of text toolkits.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ["``", "''"]


def strip_space(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def has_text(c: Column) -> Column:
    """True for text that is more than white space; null counts as empty."""
    return F.coalesce(c.rlike(ANY_MARK), F.lit(False))


def replace_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_PATTERN, URL_WORD)


def replace_code(c: Column) -> Column:
    """Fenced blocks become a marker word, inline spans vanish.

    The fence is matched lazily: the match loop needs no stack however long the block is.
    """
    return F.regexp_replace(F.regexp_replace(c, FENCE_PATTERN, FENCE_WORD), SPAN_PATTERN, "")


def clean(c: Column) -> Column:
    """URLs first, then code."""
    return replace_code(replace_urls(c))


def join_text(c: Column) -> Column:
    """Parts of a list-typed text, joined by spaces and stripped."""
    return strip_space(F.array_join(c, " "))


def tokens(c: Column) -> Column:
    """Words and punctuation marks in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def terms(c: Column) -> Column:
    """Lower-case vocabulary terms in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), F.lit(0))


def keep_content(c: Column, stop_words: list[str] | None = None) -> Column:
    """Drop stop words (any case) and punctuation tokens."""
    words = STOP_WORDS if stop_words is None else stop_words
    return F.filter(
        c, lambda t: ~F.lower(t).isin(words) & ~t.isin(PUNCTUATION)
    )


def classify_answer(c: Column, anchored: bool = False) -> Column:
    """Free-text answer -> 1 severe, 0 not severe, -1 undecided."""
    start = "^" if anchored else ""
    no, yes = c.rlike(start + DENIED_ANSWER), c.rlike(start + SEVERE_ANSWER)
    zero, one = c.contains("0"), c.contains("1")
    return (
        F.when(no | (zero & ~one), F.lit(0))
        .when(yes | (one & ~zero), F.lit(1))
        .otherwise(F.lit(-1))
    )


def strip_echo(answer: Column, prompt: Column) -> Column:
    """Remove an echoed prompt from the front of a longer answer."""
    tail = F.substring(answer, F.length(prompt) + 1, F.length(answer))
    return F.when(F.length(answer) > F.length(prompt), strip_space(tail)).otherwise(answer)


def fill_template(template: str, **slots: Column) -> Column:
    """Replace each ``$name`` of a literal template by a column.

    The template is cut at its placeholders once, so text that itself contains
    a placeholder is never filled a second time.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find(f"${name}"), name) for name in slots if f"${name}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found, key=lambda pair: (pair[0], -len(pair[1])))
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(slots[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 1 :]
    return F.concat(*pieces)


def once(c: Column, keep) -> Column:
    """Generator of ``c`` for the rows where ``keep(c)`` holds.

    A plain filter on a computed column is pushed below it and computes it again;
    a generator computes it a single time.
    """
    return F.explode(F.filter(F.array(c), keep))
