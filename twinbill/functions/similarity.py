"""Ratcliff-Obershelp similarity of two text columns.

Twice the matched characters over the joint length, where matching takes the
longest common block (earliest in the left text, then earliest in the right)
and repeats on both sides of it. The measure depends on argument order.

Spark has no such function. The UDF works on whole Arrow batches: short ASCII
texts are compared together as byte matrices, all others by ``block_matching``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinbill.functions.block_matching import LONG, matched_characters

# From this right-hand length on popular characters are ignored, which byte
# matrices do not know. It also keeps every code below within 8 bits.
_LONG = LONG
_CELLS = 1 << 17


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, length) of each text in UTF-8 bytes."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return buffer, bounds[:-1], np.diff(bounds)


def _window(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    """One column per text: ``length`` bytes from ``start``, then padding."""
    step = np.arange(max(int(length.max()), 1))[:, None]
    picked = buffer.take(start + step, mode="clip")
    np.copyto(picked, pad, where=step >= length)
    return picked


def _longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common block per column: (left start, right start, size)."""
    width, rows = b.shape
    early_b = (255 - np.arange(width, dtype=np.uint16))[:, None]
    runs = np.zeros((width + 1, rows), np.uint16)
    best = np.zeros(rows, np.int32)
    for i in range(len(a)):
        # run length ending here, in units of 256, leaving room for position
        grown = (runs[:-1] + np.uint16(256)) * (b == a[i])
        runs[1:] = grown
        top = (grown + early_b).max(axis=0).astype(np.int32)
        np.maximum(best, (top >> 8 << 16) | ((255 - i) << 8) | (top & 255), out=best)
    size = best >> 16
    return 256 - ((best >> 8) & 255) - size, 256 - (best & 255) - size, size


def _matched(
    buf_a: np.ndarray, at_a: np.ndarray, la: np.ndarray, buf_b: np.ndarray, at_b: np.ndarray, lb: np.ndarray
) -> np.ndarray:
    """Matched characters of each pair of texts, given by buffer, start and length of both sides."""
    total = np.zeros(len(la), np.int64)
    row = np.arange(len(la))
    while row.size:
        i, j, size = _longest_blocks(_window(buf_a, at_a, la, 0), _window(buf_b, at_b, lb, 255))
        total += np.bincount(row, weights=size, minlength=total.size).astype(np.int64)
        hit = size > 0
        end_a, end_b = i + size, j + size
        left = np.flatnonzero(hit & (i > 0) & (j > 0))
        right = np.flatnonzero(hit & (end_a < la) & (end_b < lb))
        part = np.concatenate([left, right])
        next_la = np.concatenate([i[left], (la - end_a)[right]])
        next_lb = np.concatenate([j[left], (lb - end_b)[right]])
        at_a = np.concatenate([at_a[left], (at_a + end_a)[right]])
        at_b = np.concatenate([at_b[left], (at_b + end_b)[right]])
        la, lb, row = next_la, next_lb, row[part]
    return total


def _distinct(left: pa.Array, right: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of ``rows`` with each pair of texts, and for each of ``rows`` the one with its pair."""
    if not rows.size:
        return rows, rows
    at = pa.array(rows)
    a, b = (side.take(at).dictionary_encode() for side in (left, right))
    key = a.indices.to_numpy().astype(np.int64) * len(b.dictionary) + b.indices.to_numpy()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], rows[first][inverse]


def ratios(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of two equally long Arrow text arrays; NaN where NULL."""
    out = np.full(len(left), np.nan)
    known = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
    buf_a, start_a, la = _bytes_of(left)
    buf_b, start_b, lb = _bytes_of(right)

    short = known & (la < _LONG) & (lb < _LONG)
    if (buf_a.max(initial=0) | buf_b.max(initial=0)) >= 128:
        high_a = np.concatenate([[0], np.cumsum(buf_a >= 128)])
        high_b = np.concatenate([[0], np.cumsum(buf_b >= 128)])
        ascii_a = high_a[start_a + la] == high_a[start_a]
        ascii_b = high_b[start_b + lb] == high_b[start_b]
        short &= ascii_a & ascii_b

    out[short & (la + lb == 0)] = 1.0
    out[short & (la + lb > 0) & ((la == 0) | (lb == 0))] = 0.0
    every = np.flatnonzero(short & (la > 0) & (lb > 0))
    # texts repeat in many pairs; each pair of texts is compared once
    todo, again = _distinct(left, right, every)
    todo = todo[np.argsort(np.maximum(la[todo], lb[todo]), kind="stable")]
    at = 0
    while at < todo.size:
        # batches of similar length, small enough to stay in cache
        span = int(max(la[todo[at]], lb[todo[at]])) + 4
        part = todo[at : at + max(64, _CELLS // span)]
        at += part.size
        sides = (buf_a, start_a[part], la[part], buf_b, start_b[part], lb[part])
        out[part] = 2.0 * _matched(*sides) / (la[part] + lb[part])

    if every.size:
        out[every] = out[again]

    rest = np.flatnonzero(known & ~short)
    if rest.size:
        pairs = list(zip(left.take(pa.array(rest)).to_pylist(), right.take(pa.array(rest)).to_pylist(), strict=True))
        distinct = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
        texts = [[pair[k] for pair in distinct] for k in (0, 1)]
        length = np.array([len(x) + len(y) for x, y in distinct])
        ratio = np.where(length == 0, 1.0, 2.0 * matched_characters(*texts) / np.maximum(length, 1))
        out[rest] = ratio[[distinct[pair] for pair in pairs]]
    return out


@F.arrow_udf(T.DoubleType())
def _ratio_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    values = ratios(left, right)
    return pa.array(values, mask=np.isnan(values))


# Spark may repeat a deterministic UDF below a filter that was written above it;
# this keeps every batch at one evaluation.
_ratio_udf = _ratio_udf.asNondeterministic()


def similarity(left: Column, right: Column, needed: Column | None = None) -> Column:
    """Similarity of two text columns in [0, 1].

    Equal and empty texts are settled in the JVM; the UDF sees NULLs for them.
    ``needed`` limits the work to some rows (others give NULL).
    """
    settled = F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0)
    open_ = settled.isNull() if needed is None else settled.isNull() & needed
    return F.coalesce(settled, _ratio_udf(F.when(open_, left), F.when(open_, right)))


def similarity_bound(left: Column, right: Column) -> Column:
    """Native upper bound of ``similarity``: the shorter text fully matched."""
    a, b = F.length(left), F.length(right)
    return F.when(a + b == 0, 1.0).otherwise(2.0 * F.least(a, b) / (a + b))


# Characters of normalised text, nine to a long; a count of up to seven is that many bits.
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PER_LONG, _BITS = 9, 7


_WORDS = len(_ALPHABET) // _PER_LONG
_MARKS = T.StructType(
    [T.StructField(f"w{k}", T.LongType()) for k in range(_WORDS)]
    + [T.StructField(f"{kind}_beyond", T.IntegerType()) for kind in ("digits", "letters")]
)
#: Place of each byte in the alphabet; all others share one behind it.
_PLACE = np.full(256, len(_ALPHABET), np.int64)
_PLACE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))


def counted_marks(texts: pa.Array) -> pa.StructArray:
    """``marks`` of an Arrow text array; NULL stays NULL."""
    buffer, start, length = _bytes_of(texts)
    ends = np.cumsum(length)
    at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    row, kinds = np.repeat(np.arange(len(texts)), length), len(_ALPHABET) + 1
    counts = np.bincount(row * kinds + _PLACE[buffer[at]], minlength=len(texts) * kinds)
    counts = counts.reshape(-1, kinds)[:, :-1]
    bits = (1 << np.minimum(counts, _BITS)) - 1
    shifts = _BITS * np.arange(_PER_LONG)
    words = (bits.reshape(-1, _WORDS, _PER_LONG) << shifts).sum(axis=2)
    beyond = np.maximum(counts - _BITS, 0).astype(np.int32)
    columns = [*words.T, beyond[:, :10].sum(axis=1), beyond[:, 10:].sum(axis=1)]
    return pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(c), pa.int64() if k < _WORDS else pa.int32()) for k, c in enumerate(columns)],
        names=_MARKS.names,
        mask=texts.is_null(),
    )


@F.arrow_udf(_MARKS)
def _marks_udf(texts: pa.Array) -> pa.Array:
    return counted_marks(texts)


def marks(text: Column) -> Column:
    """How often a normalised text holds each character, in a form whose overlap is a bit count.

    Counts are unary, so the bits two texts share are the smaller counts. What
    a character has beyond seven is added up, digits and letters apart. Whole
    Arrow batches are counted together: as column functions, 36 replacements a
    text took most of the time of the pair step.
    """
    return certain(_marks_udf(text))


def certain(counted: Column) -> Column:
    """Marks that are never NULL, which the join's condition would test at every use: its code grows beyond what
    the JVM compiles. Files give every column back as one that may be NULL. The length of a NULL text is NULL anyway.
    """
    return F.struct(*[F.coalesce(counted[f.name], F.lit(0).cast(f.dataType)).alias(f.name) for f in _MARKS])


def _shared(a: Column, b: Column, word: str, mask: int | None = None) -> Column:
    both = a[word].bitwiseAND(b[word])
    return F.bit_count(both if mask is None else both.bitwiseAND(F.lit(mask).cast("bigint")))


def multiset_bound(left: Column, right: Column, a: Column, b: Column, digits_only: bool = False) -> Column:
    """Native upper bound of ``similarity``: no more characters match than both texts hold.

    ``a`` and ``b`` are the marks of the texts, or of the texts whose digits
    they are: with ``digits_only`` other characters do not count.
    """
    beyond = F.least(a["digits_beyond"], b["digits_beyond"])
    if digits_only:
        # nine digits fill the first word, the tenth is the first of the second
        shared = _shared(a, b, "w0") + _shared(a, b, "w1", (1 << _BITS) - 1) + beyond
    else:
        shared = reduce(lambda x, y: x + y, [_shared(a, b, f"w{k}") for k in range(4)])
        shared = shared + beyond + F.least(a["letters_beyond"], b["letters_beyond"])
    length = F.length(left) + F.length(right)
    return F.when(length == 0, 1.0).otherwise(2.0 * shared / length)
