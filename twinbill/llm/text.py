"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of bytes other than space and the bytes 9 to 13; A-Z
count as a-z. Everything works on UTF-8 bytes of whole batches, so a task
spends its time in numpy, not in a loop over words. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_GOLD = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)

#: Bytes of text that one step inside a task holds (a longer text is one step).
STEP_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def chain(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hash of a sequence whose earlier part has hash ``h`` and whose next item is ``x``."""
    return mix((h ^ x) + _GOLD + (h << U(6)))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``len + 1`` offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about STEP_BYTES of ``column``, or one row."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        group = (np.cumsum(lengths) - lengths) // STEP_BYTES
        cuts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.empty(0, int)
        for start, end in zip(cuts, [*cuts[1:], len(group)], strict=False):
            yield batch.slice(start, end - start)


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses an offset."""
    n = len(mask)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    padded = np.zeros(n + 2, dtype=bool)
    padded[1:-1] = mask
    starts = np.flatnonzero(mask & (cut[:n] | ~padded[:n]))
    ends = np.flatnonzero(mask & (cut[1:] | ~padded[2:])) + 1
    return starts, ends


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets[:-1], positions, side="right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time; spans may be of any length."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) + 1,), "<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U) * _GOLD + U(seed * 2 + 1))
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        left = ends[live] - at
        block = words[at] & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = chain(h[live], block)
        more = left > 8
        live, at = live[more], at[more] + 8
    return h


class Words:
    """Words of a batch of texts: hash, byte span and row of each."""

    def __init__(self, column: pa.Array, seed: int = 0):
        self.raw, self.offsets = column_bytes(column)
        self.rows = len(self.offsets) - 1
        self.low = LOWER[self.raw]
        self.starts, self.ends = spans(~IS_SPACE[self.raw], self.offsets)
        self.hash = hash_spans(self.low, self.starts, self.ends, seed)
        self.row = row_of(self.offsets, self.starts)
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def of(self, row: int) -> np.ndarray:
        return self.hash[self.first[row] : self.first[row + 1]]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    if len(words) == 0:
        return words
    count = max(1, len(words) - width + 1)
    h = np.full(count, U(min(width, len(words))))
    for k in range(min(width, len(words))):
        h = chain(h, words[k : k + count])
    return np.unique(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
