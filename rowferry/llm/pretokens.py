"""Where the pieces of a text begin before byte pairs are merged.

The splitting pattern takes contractions, then runs of letters, of digits and of other characters with
one space before them, then white space. It needs no back-tracking: the class of a character and of
its neighbours tell whether a piece begins there, so a whole batch is split with array operations.
The classes come from the tokenizers library itself, so its Unicode version is the one that counts.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import numpy as np
from tokenizers import Regex, normalizers

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
# The letters after an apostrophe that the pattern splits off.
_SHORT = "stmd"
_LONG = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def class_runs() -> bytes:
    """Classes of all code points as runs (first code point, class), for sending to tasks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(points)
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        others = normalizers.Replace(Regex(pattern), "").normalize_str(everything)
        found = np.ones(0x110000, bool)
        found[code_points(others)] = False
        classes[found] = kind
    classes[0xD800:0xE000] = OTHER
    edges = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    return np.stack([edges, classes[edges]]).astype(np.int32).tobytes()


@lru_cache(maxsize=1)
def class_table(runs: bytes) -> np.ndarray:
    first, kinds = np.frombuffer(runs, np.int32).reshape(2, -1)
    return np.repeat(kinds.astype(np.uint8), np.diff(np.r_[first, 0x110000]))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def byte_lengths(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of every character."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def piece_starts(points: np.ndarray, texts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a piece; `texts` marks those that begin a text."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    kinds = classes[points]
    starts = texts.copy()
    starts[0] = True
    starts[1:] |= kinds[1:] != kinds[:-1]
    # The last white space before other characters is apart from the run, and a blank belongs to what follows.
    after = np.flatnonzero(starts[1:] & ~texts[1:] & (kinds[:-1] == SPACE) & (kinds[1:] != SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == ord(" ")]] = False
    quotes = np.flatnonzero(starts & (points == ord("'")))
    if len(quotes):
        _contractions(points, texts, starts, quotes)
    return starts


def _contractions(points: np.ndarray, texts: np.ndarray, starts: np.ndarray, quotes: np.ndarray) -> None:
    padded = np.r_[points, np.zeros(3, points.dtype)]
    border = np.r_[texts, np.ones(3, bool)]
    one, two = padded[quotes + 1], padded[quotes + 2]
    near = ~border[quotes + 1]
    short = near & np.isin(one, [ord(c) for c in _SHORT])
    long = np.zeros(len(quotes), bool)
    for a, b in _LONG:
        long |= (one == ord(a)) & (two == ord(b))
    long &= near & ~border[quotes + 2]
    for found, length in ((quotes[short], 2), (quotes[long], 3)):
        starts[found + 1] = False
        ends = found + length
        starts[ends[ends < len(points)]] = True


def pieces(texts: list[str], classes: np.ndarray) -> list[list[str]]:
    """The pieces of every text."""
    whole = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.zeros(len(whole), bool)
    first = np.r_[0, ends[:-1]][np.array([len(t) > 0 for t in texts], bool)] if texts else []
    begins[first] = True
    at = np.flatnonzero(piece_starts(code_points(whole), begins, classes)).tolist() + [len(whole)]
    words = [whole[a:b] for a, b in pairwise(at)]
    cuts = np.searchsorted(at, np.r_[0, ends]).tolist()
    return [words[a:b] for a, b in pairwise(cuts)]
