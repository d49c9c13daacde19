"""Matched characters of many text pairs of any length and alphabet at once.

The measure is that of ``similarity``. Texts become code points in one flat array
each for the left and the right sides, and all open pieces of all pairs advance together, one
left character a step: a run of equal characters ends at every place where
the right text holds that character, and is one longer than the run that ended one place
before. From 200 right-hand characters on, those that fill more than a
hundredth of the text start no run, but extend one, as in the standard library.
"""

from __future__ import annotations

import numpy as np

# The standard library's rule for popular characters.
LONG = 200
SHARE = 100
#: Characters of a group of pairs that is worked on together.
GROUP = 1 << 20


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the start of each, with the end last."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
    return np.frombuffer(b"".join(raw), "<u4").astype(np.int64), starts


class _Places:
    """For every left character, the places of the right text where a run can end at it."""

    def __init__(self, a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray):
        row_a = np.repeat(np.arange(len(a_starts) - 1), np.diff(a_starts))
        row_b = np.repeat(np.arange(len(b_starts) - 1), np.diff(b_starts))
        key_a, key_b = row_a * 0x110000 + a, row_b * 0x110000 + b
        order = np.argsort(key_b, kind="stable")
        kinds, first, count = np.unique(key_b[order], return_index=True, return_counts=True)
        length = np.diff(b_starts)[kinds // 0x110000]
        count[(length >= LONG) & (count > length // SHARE + 1)] = 0
        at = np.searchsorted(kinds, key_a)
        known = at < len(kinds)
        known[known] = kinds[at[known]] == key_a[known]
        self.places = order
        self.first = np.where(known, first[np.minimum(at, max(0, len(kinds) - 1))], 0) if len(kinds) else np.zeros(len(a), int)
        self.count = np.where(known, count[np.minimum(at, max(0, len(kinds) - 1))], 0) if len(kinds) else np.zeros(len(a), int)


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for every entry, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _longest(places: _Places, pieces: np.ndarray, width: int) -> np.ndarray:
    """(left start, right start, size) of the first longest run in each piece (a from, a to, b from, b to)."""
    a_low, a_high, b_low, b_high = pieces.T
    best = np.zeros((len(pieces), 3), np.int64)
    best[:, 0], best[:, 1] = a_low, b_low
    run, step_of, owner = np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)
    for step in range(int((a_high - a_low).max(initial=0))):
        live = np.flatnonzero(a_low + step < a_high)
        at = a_low[live] + step
        count = places.count[at]
        piece = np.repeat(live, count)
        end = places.places[_ragged(places.first[at], count)]
        inside = (end >= b_low[piece]) & (end < b_high[piece])
        piece, end = piece[inside], end[inside]
        if not len(piece):
            continue
        before = np.maximum(end - 1, 0)
        goes_on = (end > b_low[piece]) & (step_of[before] == step - 1) & (owner[before] == piece)
        size = np.where(goes_on, run[before], 0) + 1
        run[end], step_of[end], owner[end] = size, step, piece
        # places ascend within a piece, so the first longest run is the earliest
        heads = np.flatnonzero(np.diff(piece, prepend=-1))
        top = np.maximum.reduceat(size, heads)
        better = np.flatnonzero(top > best[piece[heads], 2])
        if not len(better):
            continue
        counts = np.diff([*heads, len(piece)])[better]
        at = _ragged(heads[better], counts)
        at = at[size[at] == np.repeat(top[better], counts)]
        at = at[np.flatnonzero(np.diff(piece[at], prepend=-1))]
        won = piece[at]
        best[won, 2] = size[at]
        best[won, 0] = a_low[won] + step + 1 - size[at]
        best[won, 1] = end[at] + 1 - size[at]
    return best


def _extended(a: np.ndarray, b: np.ndarray, pieces: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Runs made longer at both ends by any equal characters."""
    a_low, a_high, b_low, b_high = pieces.T
    i, j, size = best.T.copy()
    for back in (True, False):
        live = np.arange(len(pieces))
        while len(live):
            x, y = (i[live] - 1, j[live] - 1) if back else (i[live] + size[live], j[live] + size[live])
            fits = (x >= a_low[live]) & (y >= b_low[live]) & (x < a_high[live]) & (y < b_high[live])
            live, x, y = live[fits], x[fits], y[fits]
            same = a[x] == b[y]
            live = live[same]
            size[live] += 1
            if back:
                i[live] -= 1
                j[live] -= 1
    return np.stack([i, j, size], axis=1)


def _group(left: list[str], right: list[str]) -> np.ndarray:
    a, a_starts = _flat(left)
    b, b_starts = _flat(right)
    places = _Places(a, a_starts, b, b_starts)
    matched = np.zeros(len(left), np.int64)
    row = np.arange(len(left))
    pieces = np.stack([a_starts[:-1], a_starts[1:], b_starts[:-1], b_starts[1:]], axis=1)
    while True:
        some = (pieces[:, 0] < pieces[:, 1]) & (pieces[:, 2] < pieces[:, 3])
        pieces, row = pieces[some], row[some]
        if not len(row):
            return matched
        i, j, size = _extended(a, b, pieces, _longest(places, pieces, len(b))).T
        np.add.at(matched, row, size)
        hit = size > 0
        before = np.stack([pieces[:, 0], i, pieces[:, 2], j], axis=1)[hit]
        after = np.stack([i + size, pieces[:, 1], j + size, pieces[:, 3]], axis=1)[hit]
        pieces, row = np.concatenate([before, after]), np.concatenate([row[hit], row[hit]])


def matched_characters(left: list[str], right: list[str]) -> np.ndarray:
    """Matched characters of each pair of texts."""
    sizes = np.cumsum([len(x) + len(y) for x, y in zip(left, right, strict=True)])
    group = (sizes - 1) // GROUP
    out = np.zeros(len(left), np.int64)
    for number in np.unique(group):
        rows = np.flatnonzero(group == number)
        out[rows] = _group([left[k] for k in rows], [right[k] for k in rows])
    return out
