"""Pre-tokens of byte-level tokenizers, for a whole batch of texts at once.

The rule is the public pattern of these tokenizers: the endings 's 't 're 've
'm 'll 'd after an apostrophe, runs of letters, of digits or of other marks,
each with one space before it, and runs of white space, of which the last
character is left to what follows. Here the boundaries follow from character
classes and their neighbours, without a regular expression per text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .text import hash_spans

OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    points = np.arange(0x110000, dtype=np.uint32)
    index = points[(points < 0xD800) | (points >= 0xE000)]  # no list: a worker keeps the memory of a million numbers
    text = index.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, text):
            table[index[found.start() : found.end()]] = kind
    return table


def _starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; ``first`` is True where a text begins."""
    n = len(points)
    kind = classes()[points]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)  # last character of its text
    last[:-1] = first[1:]
    space = kind == SPACE
    blank = points == 32
    start = new.copy()
    # The space before a run belongs to it.
    start[1:] &= ~(blank[:-1] & ~space[1:] & ~first[1:])
    # The last white space before something else stands alone or goes with it.
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= tail
    for i in np.flatnonzero((points == 39) & start & ~last).tolist():
        ending = _ending(points, last, i)
        if ending:
            start[i + 1] = False
            after = i + 1 + ending
            if after < n and not first[after] and kind[after] == LETTER:
                start[after] = True
    return start


def _ending(points: np.ndarray, last: np.ndarray, i: int) -> int:
    one = chr(points[i + 1])
    if one in "stmd":
        return 1
    if one in "rvl" and not last[i + 1]:
        return 2 if one + chr(points[i + 2]) in ("re", "ve", "ll") else 0
    return 0


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of the texts ``raw[offsets[i]:offsets[i + 1]]``."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(raw) + 1, bool)
    inside[offsets] = True
    starts = head[_starts(points, inside[head])]
    return starts, np.append(starts[1:], len(raw))


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each different string, and for every span the index of its string there."""
    _, at, which = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
    return at, which


def gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[first[i]:first[i] + count[i]]`` for all i, one after the other."""
    ends = np.cumsum(count)
    if not len(ends):
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
