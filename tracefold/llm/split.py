"""Texts as matches of the public byte-level pattern, and ids by distinct match."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex

#: A text is cut into parts of about so many characters, always where no match can go on.
PART = 1 << 20
#: A worker keeps the ids of about so many distinct matches.
WORDS = 800_000
#: Before a single space between two other characters: a match has a space only at its start, or is white space alone.
_CUT = regex.compile(r"(?<=\S)(?= \S)")

#: Over these characters the standard library's classes say the same as the pattern's, in two thirds of the time.
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+").findall
_NOT_PLAIN = re.compile("[^\t-\r -^`-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search


def matcher(pattern: str):
    """All matches of the pattern in a text."""
    find = regex.compile(pattern).findall
    return find if pattern != _PLAIN_PATTERN else lambda text: find(text) if _NOT_PLAIN(text) else _PLAIN(text)


def parts(text: str, most: int = PART) -> Iterator[str]:
    """Parts of the text whose matches, one after the other, are those of the whole text."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def assemble(first: np.ndarray, ids: np.ndarray, count: np.ndarray, other: np.ndarray, other_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of words in their common order: where ``first`` holds, the next of ``ids``, else of ``other``."""
    total = np.empty(len(first), np.int64)
    total[first], total[~first] = count, other_count
    mask = np.repeat(first, total)
    both = np.empty(len(mask), np.int64)
    both[mask], both[~mask] = ids, other
    return both, total


class WordTable:
    """Ids of whole texts from the ids of their distinct matches, each asked for once while the table keeps it."""

    def __init__(self, pattern: str, special: frozenset[str] = frozenset()):
        """``special``: strings that are words of their own wherever they stand; texts are matched between them."""
        self.find, self.most, self.special = matcher(pattern), WORDS, special
        self.clear()

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that the table has not got, one word after the other, and how many each has."""
        raise NotImplementedError

    def sections(self, text: str) -> Iterator[str]:
        """The text cut before and after each special string in it."""
        return self.cut(text) if any(x in text for x in self.special) else iter((text,))

    def cut(self, text: str) -> Iterator[str]:
        return (x for x in re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if x)

    def clear(self) -> None:
        self.place: dict[str, int] = defaultdict(lambda: len(self.place))
        self.ids, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents one after the other, and where each document ends."""
        if len(self.place) > self.most:
            self.clear()
        known, found, ends = len(self.place), [np.zeros(0, np.int32)], []
        for text in documents:
            n = 0
            for section in self.sections(text):
                for part in [section] if section in self.special else parts(section):
                    words = [part] if part in self.special else self.find(part)
                    found.append(np.array([*map(self.place.__getitem__, words)], np.int32))
                    n += len(found[-1])
            ends.append(n)
        words = np.concatenate(found)
        if len(self.place) > known:
            ids, count = self.fresh([*islice(self.place, known, None)])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.count = np.concatenate([self.count, count])
        count = self.count[words]
        stops = np.cumsum(count)
        at = np.repeat(self.start[words] - stops + count, count)
        at += np.arange(len(at))
        return self.ids[at], np.concatenate([[0], stops])[np.cumsum(ends, dtype=np.int64)]
