"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

#: A worker keeps the hashes of about so many words.
WORDS = 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_FACTORS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(defaultdict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_known = _Hashes()


def forget() -> None:
    """Gives the memory of known words back."""
    _known.clear()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _SHIFTS[0]) * _FACTORS[0]
    h = (h ^ h >> _SHIFTS[1]) * _FACTORS[1]
    return h ^ h >> _SHIFTS[2]


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingles of ``words`` words, A-Z in lower case, as sorted hashes.

    Words are divided by the characters 0x20 and 0x09 to 0x0D. Fewer words are one shingle, none an empty set.
    """
    if len(_known) > WORDS:
        _known.clear()
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.array([*map(_known.__getitem__, found)], np.uint64)
    n = min(words, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _MULTIPLIER + hashes[k : len(hashes) - n + 1 + k]
    return np.unique(mix(total))
