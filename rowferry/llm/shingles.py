"""Words and word windows as 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 200_000


def scramble(values: np.ndarray) -> np.ndarray:
    """Mixes all bits of 64-bit numbers (two multiply and shift rounds)."""
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(32)


class WordNumbers(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value

    def of(self, words: Sequence[str]) -> np.ndarray:
        if len(self) > _REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of consecutive words; none if there are fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _FACTOR + words[k:k + n]
    return scramble(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter text is one window, a text without words has none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))))
