"""Blocks of texts that ask hash shards about their keys.

Some operators must know how often, or how early, a key (an n-gram, a chunk)
occurs in the whole corpus, for every key of every text. One row per key would
shuffle several times the input. Here texts are packed into blocks of bounded
size; a block sends each distinct key once, sorted and packed into one binary
per hash shard, and gets an answer in the same order, so answers carry no keys.

* A shard holds keys with the same leading hash bits, so a frequent key costs
  one entry per block and shards stay even, whatever the skew.
* Blocks are a written table: their ids and order stay the same for each pass
  and for each retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .text import U, column_bytes, steps

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: Keys that one shard gets, about, from all blocks together.
SHARD_KEYS = 2_000_000


def packed(array: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: equal leading bytes cost next to nothing."""
    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), array.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U), dtype=U)


class Block:
    """Texts of a block: ``ids`` (with ``known``, False for null), ``fold``, and Arrow text."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.fold = np.frombuffer(row["fold"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = zstandard.ZstdDecompressor().decompress(row["text"]) if offsets[-1] else b""
        self.text = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)
        )

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.known)

    def parts(self) -> Iterator[tuple[int, pa.Array]]:
        """Text columns of a few MB, each with the row it starts at."""
        at = 0
        for batch in steps(iter([pa.record_batch([self.text], names=["text"])])):
            yield at, batch.column("text")
            at += batch.num_rows


BLOCK_SCHEMA = "block long, special boolean, bytes long, ids binary, known binary, fold binary, sizes binary, text binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}

    def block(special: bool) -> pa.RecordBatch:
        nonlocal number
        table = pa.Table.from_batches(held[special]).combine_chunks()
        held[special], size[special] = [], 0
        raw, offsets = column_bytes(table.column("text"))
        ids = table.column("doc_id")
        row = {
            "block": number,
            "special": special,
            "bytes": len(raw),
            "ids": np.asarray(pc.fill_null(ids, 0)).astype(np.int64).tobytes(),
            "known": np.asarray(pc.is_valid(ids)).tobytes(),
            "fold": np.asarray(table.column("fold")).astype(np.int64).tobytes(),
            "sizes": np.diff(offsets).tobytes(),
            "text": zstandard.ZstdCompressor(level=3).compress(raw.tobytes()) if len(raw) else b"",
        }
        number += 1
        return pa.RecordBatch.from_pylist([row])

    for batch in steps(batches):
        apart = np.asarray(batch.column("special"))
        for special in (False, True):
            part = batch.filter(pa.array(apart == special))
            if part.num_rows:
                held[special].append(part)
                size[special] += part.column("text").nbytes
                if size[special] >= BLOCK_BYTES:
                    yield block(special)
    for special in (False, True):
        if held[special]:
            yield block(special)


def blocks(docs: DataFrame, fold=None, special=None) -> DataFrame:
    """Block table of ``docs`` (doc_id, text), written to the shared folder.

    ``fold`` is a number kept for every row; rows where ``special`` holds go
    to blocks of their own, so that a pass can read those alone.
    """
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text",
            (fold if fold is not None else F.lit(0)).cast("long").alias("fold"),
            (special if special is not None else F.lit(False)).alias("special"),
        ).mapInArrow(_pack, BLOCK_SCHEMA),
        "blocks",
    )


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


def shard_bits(table: DataFrame, keys_per_byte: float) -> int:
    """Leading hash bits that make shards of about SHARD_KEYS keys."""
    total = table.agg(F.sum("bytes")).first()[0] or 0
    shards = max(16, total * keys_per_byte / SHARD_KEYS)
    return int(np.ceil(np.log2(shards)))


def shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places where the sorted keys of each shard begin, and the end."""
    return np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1).astype(U))


def question_rows(block: int, kind: int, keys: np.ndarray, values: list[np.ndarray], bits: int) -> Iterator[dict]:
    """One row per shard for sorted distinct ``keys`` and their values."""
    edges = shard_edges(keys, bits)
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        low, high = edges[shard], edges[shard + 1]
        yield {
            "shard": shard,
            "kind": kind,
            "block": block,
            "keys": packed_keys(keys[low:high]),
            "values": [packed(v[low:high]) for v in values],
        }


QUESTION_SCHEMA = "shard int, kind int, block long, keys binary, values array<binary>"
ANSWER_SCHEMA = "block long, kind int, shard int, totals array<long>, values array<binary>"


def answers(questions: DataFrame, merge: Callable) -> DataFrame:
    """Ask the shards.

    ``merge(kind, blocks, keys, values)`` gets, for each block that asks, its
    sorted keys and raw values; it returns the answer columns of each block
    and a list of totals for the shard (a row with block -1).
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for kind in sorted({r["kind"] for r in rows}):
            own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["block"])
            found, totals = merge(
                kind, [r["block"] for r in own], [unpacked_keys(r["keys"]) for r in own], [r["values"] for r in own]
            )
            shard = own[0]["shard"]
            out.append({"block": -1, "kind": kind, "shard": shard, "totals": totals, "values": []})
            out += [
                {"block": r["block"], "kind": kind, "shard": shard, "totals": [], "values": [packed(v) for v in values]}
                for r, values in zip(own, found, strict=True)
            ]
        return pa.Table.from_pylist(out, schema=_ANSWERS)

    return materialize(questions.groupBy("shard").applyInArrow(run, ANSWER_SCHEMA), "answers")


_ANSWERS = pa.schema(
    [
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("shard", pa.int32()),
        ("totals", pa.list_(pa.int64())),
        ("values", pa.list_(pa.binary())),
    ]
)


def collected(rows: list[dict], kind: int, dtypes: list) -> list[np.ndarray]:
    """The answer columns of one block for all its keys of a kind, in key order."""
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])
    return [
        np.concatenate([unpacked(r["values"][k], dtype) for r in own]) if own else np.empty(0, dtype)
        for k, dtype in enumerate(dtypes)
    ]


def with_answers(table: DataFrame, answer: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Bring each block together with its answers: ``work(Block, rows) -> pa.Table``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(Block(left.to_pylist()[0]), right.to_pylist())

    return (
        table.groupBy("block")
        .cogroup(answer.where("block >= 0").join(table.select("block"), "block", "left_semi").groupBy("block"))
        .applyInArrow(run, schema)
    )
