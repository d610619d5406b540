"""Exact token ids at the speed of a word table.

A pre-token's ids do not depend on its neighbours, so each distinct pre-token is encoded by the
library once and its ids are kept as bytes. Texts with characters outside the ranges checked in the
tests, with special strings, or not in composed form go through the library as a whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np

MAX_WORDS = 1_000_000  # entries of a task's word table before it starts anew, about 200 MB

# Letters and digits among the characters that the fast path accepts (Latin, Cyrillic, Han).
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
WIDE = LATIN + "Ā-ƀЀ-ҁ一-龥"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\\t\\n\\r "
UNCHECKED = re.compile("[^\\t\\n\\r -~¡-¬®-įĲ-ƀЀ-ҁ一-龥]")
BEYOND_LATIN = re.compile("[^\\x00-ÿ]")


def byte_level(letters: str) -> str:
    """Fixed value: the published splitting pattern; its first and last parts cannot compete."""
    return (
        f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^{SPACES}{letters}{DIGITS}]+"
        f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


def word_level(letters: str) -> str:
    """Fixed value: the published splitting pattern of the lower-casing vocabulary."""
    return f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{SPACES}{letters}{DIGITS}]+"


def byte_names() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's.

    ``lower`` says that the vocabulary lower-cases and drops white space.
    """

    def __init__(self, path: str, lower: bool, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.lower = lower
        rule = word_level if lower else byte_level
        self.split, self.split_wide = (re.compile(rule(x)).findall for x in (LATIN, WIDE))
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.names = byte_names()
        self.words: dict[str, bytes] = {}
        self.max_words = max_words

    def plain(self, text: str) -> bool:
        if UNCHECKED.search(text) or any(s in text for s in self.specials):
            return False
        return not self.lower or text.isascii() or unicodedata.is_normalized("NFC", text)

    def pieces(self, text: str) -> list[str]:
        if self.lower:
            text = text.lower()
        return (self.split_wide if BEYOND_LATIN.search(text) else self.split)(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, dtype="<u4").tobytes()
        pieces = self.pieces(text)
        try:
            return b"".join(map(self.words.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return b"".join(map(self.words.__getitem__, pieces))

    def _learn(self, pieces: list[str]) -> None:
        if len(self.words) > self.max_words:
            self.words.clear()
        for word in set(pieces).difference(self.words):
            named = word.encode().decode("latin-1").translate(self.names)
            ids = [t.id for t in self.model.tokenize(named)]
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def encoder(path: str, lower: bool) -> WordEncoder:
    """One word table per worker process and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path, lower)


def file_version(path: str) -> str:
    """Digest of a vocabulary file: the version of its tokenizer."""
    import hashlib

    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


def crc(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF
