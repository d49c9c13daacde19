"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text: every byte shifts the hash
and adds its random number, so a value depends on the last ``GEAR`` bytes only. A
chunk begins where the value is the smallest of the ``reach`` places before and
after it. Cuts thus depend on the bytes nearby alone, and an insertion moves
those around it and no others; chunks have ``2 * reach`` bytes on average.

A chunk is repeated if an earlier document (by doc_id) has a chunk with the same
digest. Digests of all chunks are settled in hash shards (``exchange``). Runs of
repeated chunks with at least ``min_words`` words are taken out; a shorter run
is a common phrase, not a copied passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import (
    QUESTION_SCHEMA,
    Block,
    answers,
    blocks,
    collected,
    each_block,
    question_rows,
    shard_bits,
    unpacked,
    with_answers,
)
from .text import IS_SPACE, column_bytes, hash_spans, row_of, spans

#: Bytes that a gear value depends on (a power of two).
GEAR = 16
_TABLE = np.random.default_rng(271828).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """``longest``: a chunk without a cut is divided every so many bytes from its start."""

    reach: int = 16
    longest: int = 1024
    min_words: int = 20


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling value at each byte: the sum of table entries of the last GEAR bytes, shifted by their age."""
    h = _TABLE[raw]
    span = 1
    while span < GEAR:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values that begin at each place (fewer at the end)."""
    out, have = values.copy(), 1
    while have < width:
        more = min(have, width - have)
        out[:-more] = np.minimum(out[:-more], out[more:])
        have += more
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray, rule: Chunking) -> np.ndarray:
    """Sorted byte places where chunks begin; every text that is not empty begins one."""
    sizes = np.diff(offsets)
    some = sizes > 0
    pad = GEAR + rule.reach
    # Texts stand apart, so that none has an influence on its neighbour.
    shift = (np.arange(len(sizes)) + 1) * pad
    apart = np.zeros(len(raw) + (len(sizes) + 1) * pad, np.uint8)
    inside = np.zeros(len(apart), bool)
    place = np.arange(len(raw)) + np.repeat(shift, sizes)
    apart[place] = raw
    inside[place] = True
    h = gear(apart)
    h[~inside] = np.uint32(2**32 - 1)
    ahead = _least(h, rule.reach + 1)
    before = np.full(len(h), np.uint32(2**32 - 1))
    before[rule.reach :] = _least(h, rule.reach)[: -rule.reach]
    found = np.flatnonzero((h < before) & (h == ahead) & inside)
    found = found - shift[np.searchsorted(offsets[:-1] + shift, found, side="right") - 1] if len(found) else found
    start = np.unique(np.concatenate([found, offsets[:-1][some]]))
    # Cut long chunks by length, counted from their own start.
    length = np.diff(np.append(start, len(raw)))
    length = np.minimum(length, offsets[1:][row_of(offsets, start)] - start)
    extra = (length - 1) // rule.longest
    if extra.any():
        which = np.repeat(np.arange(len(start)), extra)
        step = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        start = np.unique(np.concatenate([start, start[which] + step * rule.longest]))
    # Never inside a character.
    for _ in range(3):
        middle = (raw[start] & 0xC0) == 0x80
        if not middle.any():
            break
        start = np.where(middle, start + 1, start)
        start = start[start < len(raw)]
    return np.unique(start)


class BlockChunks:
    """Chunks of a block: span, row, and index into the sorted distinct digests."""

    def __init__(self, block: Block, rule: Chunking):
        raw, self.offsets = column_bytes(block.text)
        self.raw = raw
        parts = []
        for at, column in block.parts():
            own, offsets = column_bytes(column)
            parts.append(cuts(own, offsets, rule) + self.offsets[at])
        self.starts = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.ends = np.append(self.starts[1:], len(raw))[: len(self.starts)]
        self.row = row_of(self.offsets, self.starts)
        self.keys, self.index = np.unique(hash_spans(raw, self.starts, self.ends), return_inverse=True)
        # Rows without an id come after all others and are never repeated.
        self.owner = np.where(block.known, block.ids, np.iinfo(np.int64).max)[self.row]
        self.known = block.known
        self.first = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.index, self.owner)


_QUESTIONS = pa.schema(
    [
        ("shard", pa.int32()),
        ("kind", pa.int32()),
        ("block", pa.int64()),
        ("keys", pa.binary()),
        ("values", pa.list_(pa.binary())),
    ]
)


def _questions(rule: Chunking, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            chunks = BlockChunks(block, rule)
            rows = list(question_rows(block.block, 0, chunks.keys, [chunks.first], bits))
            for start in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist(rows[start : start + 512], schema=_QUESTIONS)

    return run


def _first_owner(_: int, __: list[int], keys: list[np.ndarray], values: list[list[bytes]]):
    """For each block's keys: whether the corpus has an earlier document than the block's first."""
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([unpacked(v[0], np.int64) for v in values])
    first = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(first, index, own)
    earlier = first[index] < own
    edges = np.cumsum([len(k) for k in keys])[:-1]
    return [[part.astype(np.uint8)] for part in np.split(earlier, edges)], [len(every)]


def _cutting(rule: Chunking):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_chunks", pa.int64()), ("repeated_chunks", pa.int64()),
         ("removed_bytes", pa.int64())]
    )

    def work(block: Block, rows: list[dict]) -> pa.Table:
        chunks = BlockChunks(block, rule)
        earlier = collected(rows, 0, [np.uint8])[0].astype(bool)
        repeated = (earlier[chunks.index] | (chunks.owner > chunks.first[chunks.index])) & chunks.known[chunks.row]
        n = len(block.ids)
        # Runs of repeated chunks inside one text.
        edges = np.searchsorted(chunks.row, np.arange(n + 1))
        low, high = spans(repeated, edges)
        begin, end = chunks.starts[low], chunks.ends[np.maximum(high - 1, 0)] if len(high) else high
        words, _ = spans(~IS_SPACE[chunks.raw], chunks.offsets)
        long = np.searchsorted(words, end) - np.searchsorted(words, begin) >= rule.min_words
        begin, end = begin[long], end[long]
        change = np.zeros(len(chunks.raw) + 1, np.int8)
        change[begin] += 1
        np.add.at(change, end, -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[chunks.offsets]
        text = pa.LargeStringArray.from_buffers(
            n, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(chunks.raw[keep].tobytes())
        )
        return pa.table(
            [
                block.doc_ids(),
                text.cast(pa.string()),
                pa.array(np.diff(edges)),
                pa.array(np.bincount(chunks.row, repeated, n).astype(np.int64)),
                pa.array(np.diff(chunks.offsets) - np.diff(kept)),
            ],
            schema=schema,
        )

    return work, "doc_id long, text string, n_chunks long, repeated_chunks long, removed_bytes long"


def substring_dedup(docs: DataFrame, rule: Chunking | None = None) -> DataFrame:
    """Texts of ``docs`` (doc_id, text) without passages that an earlier document has.

    One row per row: doc_id, text, n_chunks, repeated_chunks (in an earlier
    document, whether taken out or not), removed_bytes. Null and empty texts
    have no chunks and give an empty text. Rows that share a doc_id count as
    one document and keep what they share; a row with a null doc_id keeps its
    text and makes no other row lose any. Other columns are ignored; an empty
    table gives no rows. The first document with a passage keeps it, so a passage
    of any number of documents is kept once.
    """
    rule = rule or Chunking()
    table = blocks(docs)
    bits = shard_bits(table, 0.04)
    answer = answers(table.mapInArrow(_questions(rule, bits), QUESTION_SCHEMA), _first_owner)
    return with_answers(table, answer, *_cutting(rule))
