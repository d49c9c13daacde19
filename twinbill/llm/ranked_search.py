"""Ranked lexical search with bag deduplication.

Every item of a query table gets its best documents by a whole-number form of
BM25. All arithmetic is exact, so equal documents have equal scores.

1. Restrict: one scan cuts every whole text into terms and keeps its length and its
   bag, the (term, count) pairs of terms that some item uses, packed in order of the terms.
2. Collection figures (documents, terms, documents of a term) are sums over that table.
3. Classes: a score depends on nothing but the bag and the length norm m. Rows meet by a
   hash of both and are verified by the bytes themselves, so a class is a group of equal
   (m, bag), however many documents it has. One row a class stays, with its least doc_id.
4. Score: every class is scored once against all items; a task keeps the best ``depth``
   classes of an item (by score, then least doc_id), which always hold the best
   ``depth`` documents.
5. Expand: members of the winning classes only, the ``depth`` smallest doc_ids of each.

Items are worked on in blocks of bounded size; the terms of one block go along with
the tasks. Another block means another pass, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, only
from .text import LOWER, column_bytes, row_of, spans, steps

# A term is a run of ASCII letters, digits and all characters beyond ASCII.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[0x30:0x3A] = IS_TERM[0x41:0x5B] = IS_TERM[0x61:0x7B] = True
IS_TERM[0x80:] = True

#: One entry of a packed bag.
ENTRY = np.dtype([("term", "<u4"), ("count", "<u4")])
#: Cells of classes times items, or single contributions, that one step of scoring holds.
STEP_CELLS = 1 << 19


@dataclass(frozen=True)
class Ranking:
    """Documents an item gets, and bytes of item text that go along with a task as one block."""

    depth: int = 20
    block_bytes: int = 4 << 20


class Terms:
    """Terms of a batch of texts, lower-cased where ASCII: their bytes and the row of each."""

    def __init__(self, column: pa.Array):
        raw, offsets = column_bytes(column)
        self.rows = len(offsets) - 1
        starts, ends = spans(IS_TERM[raw], offsets)
        self.row = row_of(offsets, starts)
        edges = np.empty(2 * len(starts) + 1, np.int64)
        edges[0:-1:2], edges[1::2] = starts, ends
        edges[-1] = ends[-1] if len(ends) else 0
        low = LOWER[raw]
        # terms and the gaps after them lie in one buffer; every other piece is a term
        pieces = pa.Array.from_buffers(
            pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(low)]
        )
        self.bytes = pieces.take(pa.array(np.arange(0, 2 * len(starts), 2)))

    @property
    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


@dataclass
class ItemBlock:
    """Items of one block: their ids, distinct terms, and for each term the items that use it and how often."""

    ids: list[int]
    terms: pa.Array
    first: np.ndarray
    item: np.ndarray
    uses: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> ItemBlock:
        ids = sorted({i for i, _ in rows})
        place = {i: k for k, i in enumerate(ids)}
        found = Terms(pa.array([text for _, text in rows], pa.string()))
        owner = np.array([place[i] for i, _ in rows], np.int64)[found.row]
        names = found.bytes.unique()
        term = np.asarray(pc.index_in(found.bytes, value_set=names)).astype(np.int64)
        pairs, uses = np.unique(term * len(ids) + owner, return_counts=True)
        first = np.searchsorted(pairs, np.arange(len(names) + 1) * len(ids))
        return cls(ids, names, first, pairs % max(1, len(ids)), uses)


def _restricted(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """``(doc_id, n, bag)`` of every row: all its terms counted, those of the block kept."""
    names = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = Terms(batch.column("text"))
            term = pc.fill_null(pc.index_in(found.bytes, value_set=names), -1).to_numpy(zero_copy_only=False)
            known = term >= 0
            keys, counts = np.unique(found.row[known] * (len(names) + 1) + term[known], return_counts=True)
            entries = np.empty(len(keys), ENTRY)
            entries["term"], entries["count"] = keys % (len(names) + 1), counts
            edges = np.searchsorted(keys, np.arange(found.rows + 1) * (len(names) + 1)) * ENTRY.itemsize
            bags = pa.Array.from_buffers(
                pa.large_binary(), found.rows, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(entries.tobytes())]
            )
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(found.lengths.astype(np.int64)), bags.cast(pa.binary())],
                names=["doc_id", "n", "bag"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, bag binary")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of bags and the row of each."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, ENTRY), np.empty(0, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data.view(ENTRY), np.repeat(np.arange(len(column)), np.diff(bounds) // ENTRY.itemsize)


def _weights(bags: DataFrame, block: ItemBlock, documents: int) -> np.ndarray:
    """Weight of each term of the block from the documents that hold it."""
    size = len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_entries(batch.column("bag"))[0]["term"], minlength=size)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["term", "documents"])

    found = (
        bags.select("bag")
        .mapInArrow(run, "term long, documents long")
        .groupBy("term")
        .agg(F.sum("documents").alias("documents"))
        .collect()
    )  # one row a term of the block
    weights = np.zeros(size, np.int64)
    for r in found:
        weights[r["term"]] = floor(1000 * log((2 * documents + 2) / (2 * r["documents"] + 1)))
    return weights


class Best:
    """The best classes of every item so far: by score, then by least doc_id (null last)."""

    def __init__(self, items: int, depth: int):
        self.depth = depth
        self.rows = np.empty((0, 5), np.int64)  # item, score, first is null, first, class
        self.floor = np.zeros(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, first: np.ndarray, ident: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([item, score, null, first, ident], axis=1)])
        rows = rows[np.lexsort([rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]])]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - starts < self.depth]
        full, last = np.unique(self.rows[:, 0], return_index=True)
        counts = np.diff([*last, len(self.rows)])
        ends = last + counts - 1
        self.floor[full] = np.where(counts == self.depth, self.rows[ends, 1], 0)


def _scored(classes: DataFrame, block: ItemBlock, weights: np.ndarray, depth: int) -> DataFrame:
    """``(item, score, first, class)``: the best classes of each item in each task."""
    items = len(block.ids)
    used = np.diff(block.first)

    def scores_of(entries: np.ndarray, row: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Score of every row for every item."""
        term, count = entries["term"].astype(np.int64), entries["count"].astype(np.int64)
        value = weights[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m[row]))
        times = used[term]
        at = np.repeat(block.first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = np.repeat(row * items, times) + block.item[at]
        part = np.repeat(value, times) * block.uses[at]
        sums = np.zeros(len(m) * items, np.int64)
        np.add.at(sums, key, part)
        return sums.reshape(len(m), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, depth)
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, row = _entries(batch.column("bag"))
            pieces = np.add.reduceat(used[entries["term"]], np.searchsorted(row, np.arange(batch.num_rows))) + items
            group = (np.cumsum(pieces) - pieces) // STEP_CELLS
            for start, end in _runs(group):
                part = batch.slice(start, end - start)
                low, high = np.searchsorted(row, [start, end])
                scores = scores_of(entries[low:high], row[low:high] - start, np.asarray(part.column("m")))
                at, item = np.nonzero((scores > 0) & (scores >= best.floor))
                first = part.column("first")
                best.add(
                    item,
                    scores[at, item],
                    np.asarray(first.is_null()).astype(np.int64)[at],
                    np.asarray(pc.fill_null(first, 0))[at],
                    np.asarray(part.column("class"))[at],
                )
        item, score, null, first, ident = best.rows.T
        yield pa.record_batch(
            [pa.array(item), pa.array(score), pa.array(first, mask=null.astype(bool)), pa.array(ident)],
            names=["item", "score", "first", "class"],
        )

    return classes.mapInArrow(run, "item long, score long, first long, class long")


def _runs(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of every run of equal values."""
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    return zip(cuts, [*cuts[1:], len(group)], strict=True)


def _best_of(rows: DataFrame, by: str, order: list, depth: int) -> DataFrame:
    """The first ``depth`` rows of each ``by``; Spark cuts each task's share before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= depth)


def _search_block(docs: DataFrame, block: ItemBlock, rule: Ranking) -> DataFrame:
    bags = materialize(_restricted(docs, block), "bags")
    totals = bags.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"] or 0
    weights = _weights(bags, block, documents)
    # rows without a term of the items score 0
    held = bags.where(F.length("bag") > 0).select(
        "doc_id",
        "bag",
        F.expr(f"75 + (25 * n * {documents}L) div {max(terms, 1)}L").alias("m"),
    )
    held = held.withColumn("hash", F.xxhash64("m", "bag"))
    # the hash spreads rows over the partitions; bag and m beside it in the key verify it
    classes = materialize(
        held.groupBy("hash", "m", "bag")
        .agg(F.min("doc_id").alias("first"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    order = [F.desc("score"), F.asc_nulls_last("first")]
    scored = _scored(classes.select("m", "bag", "first", "class"), block, weights, rule.depth)
    winners = materialize(_best_of(scored, "item", order, rule.depth).select("item", "score", "class"), "winners")
    # written, so that its size is known before the join with all documents is planned
    wanted = materialize(
        classes.join(winners.select("class").distinct(), "class").select("class", "hash", "m", "bag"), "wanted"
    )
    members = held.join(wanted, ["hash", "m", "bag"]).select("class", "doc_id")
    members = _best_of(members, "class", [F.asc_nulls_last("doc_id")], rule.depth).drop("rank")
    ranked = _best_of(
        winners.join(members, "class"), "item", [F.desc("score"), F.asc_nulls_last("doc_id")], rule.depth
    )
    ids = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item long, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, rule: Ranking | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``depth`` rows of ``docs`` for each item.

    A row of ``docs`` is a document of its own, also where ids or texts repeat;
    null and empty texts have no terms, null ids rank after all others of their
    score. Rows of one item_id count as one item: equal texts once, different
    texts together. Items with a null id or without a known term have no rows, other columns
    are ignored, and empty tables give an empty result.
    """
    rule = rule or Ranking()
    spark = docs.sparkSession
    asked = materialize(
        only(items, "item_id", "text")
        .where("item_id is not null and text <> ''")
        .select(F.col("item_id").cast("long").alias("item_id"), "text")
        .distinct(),
        "items",
    )
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // rule.block_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(count):
        share = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == number)
        # Bounded by block_bytes, or one item's text.
        rows = [(r["item_id"], r["text"]) for r in share.collect()]
        if rows:
            found = _search_block(docs, ItemBlock.of(rows), rule)
            out = out.unionByName(found if count == 1 else materialize(found, "ranked"))
    return out
