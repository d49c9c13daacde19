"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two passes over the documents, neither of which moves a text:

1. Count every benchmark word in all documents. A gram is rare if its words,
   were they independent, would meet in at most ``seed_chance`` of the word
   positions. Expected counts, not observed ones, decide: a passage that has
   leaked into a third of the corpus is still made of rare grams.
2. Look up the grams of every document among the rare grams of the test items;
   each item that shares a seed is aligned, word by word, with the surroundings
   of its seeds. Match, mismatch and gap scores let copies with changed,
   inserted or lost words through.

Test items travel to the executors in blocks of at most ``block_bytes``; a
larger benchmark takes one more pass for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, only
from .text import U, Words, chain, steps


@dataclass(frozen=True)
class Alignment:
    """``gram`` words a seed. A passage counts from ``coverage`` of the best possible score on."""

    gram: int = 3
    seed_chance: float = 1e-6
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    coverage: float = 0.4
    block_bytes: int = 16 << 20


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    count = max(0, len(words) - width + 1)
    h = np.full(count, U(width))
    for k in range(width):
        h = chain(h, words[k : k + count])
    return h


class Block:
    """Test items of one block: their words, and after ``rare`` their seeds."""

    def __init__(self, ids: list[int], texts: list[str], rule: Alignment):
        words = Words(pa.array(texts, pa.string()))
        some = [k for k in range(len(ids)) if len(words.of(k))]
        self.ids = [ids[k] for k in some]
        self.items = [words.of(k).copy() for k in some]
        self.rule = rule
        self.words = np.unique(np.concatenate(self.items)) if some else np.empty(0, U)

    def rare(self, counts: np.ndarray, total: int) -> None:
        """Pick the seeds; an item too short or without a rare gram is seeded by its rarest runs."""
        rule = self.rule
        chance = np.log10(np.maximum(counts, 1) / max(total, 1))
        seeds, items, places = [], [], []
        for k, item in enumerate(self.items):
            width = min(rule.gram, len(item))
            grams = _grams(item, width)
            weight = np.convolve(chance[np.searchsorted(self.words, item)], np.ones(width), "valid")
            keep = weight <= np.log10(rule.seed_chance)
            if not keep.any():
                keep = weight <= weight.min()
            seeds.append(grams[keep])
            places.append(np.flatnonzero(keep))
            items.append(np.full(keep.sum(), k))
        self.widths = sorted({min(rule.gram, len(item)) for item in self.items})
        seed = np.concatenate(seeds) if seeds else np.empty(0, U)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.seed_item = np.concatenate(items)[order] if seeds else np.empty(0, int)
        self.seed_place = np.concatenate(places)[order] if seeds else np.empty(0, int)


def _blocks(benchmark: DataFrame, rule: Alignment) -> Iterator[Block]:
    """Test items by id, block after block; only one block is on the driver at a time."""
    rows = (
        only(benchmark, "item_id", "text")
        .where("item_id is not null and text is not null")
        .orderBy("item_id", "text")
        .toLocalIterator()
    )
    ids, texts, held = [], [], 0
    for row in rows:
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"].encode())
        if held >= rule.block_bytes:
            yield Block(ids, texts, rule)
            ids, texts, held = [], [], 0
    if ids:
        yield Block(ids, texts, rule)


def _counter(block: Block):
    known = block.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(known), np.int64), 0
        for batch in steps(batches):
            words = Words(batch.column("text")).hash
            total += len(words)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            counts += np.bincount(at[known[at] == words], minlength=len(known))
        place = np.append(np.flatnonzero(counts), -1)
        yield pa.record_batch(
            [pa.array(place), pa.array(np.append(counts[place[:-1]], total))], names=["place", "n"]
        )

    return run


def local_alignment(item: np.ndarray, text: np.ndarray, rule: Alignment) -> tuple[int, int, int]:
    """Best Smith-Waterman score and the word span ``[start, end)`` of the text that has it.

    Of equal scores the one that ends first, then the one that starts last.
    """
    n = len(text)
    index = np.arange(n + 1)
    score, origin = np.zeros(n + 1, np.int64), index.copy()
    best = (0, 0, 0)
    for word in item:
        step = np.where(text == word, rule.match, rule.mismatch)
        new = np.concatenate([[0], score[:-1] + step])
        start = np.concatenate([[0], origin[:-1]])
        down = score + rule.gap
        better = down > new
        new, start = np.where(better, down, new), np.where(better, origin, start)
        empty = new <= 0
        new, start = np.where(empty, 0, new), np.where(empty, index, start)
        # A run of gaps along the text: the best earlier cell less the gaps since.
        reach = new - rule.gap * index
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, index, 0))
        along = top + rule.gap * index
        longer = along > new
        score, origin = np.where(longer, along, new), np.where(longer, start[source], start)
        origin = np.where(score <= 0, index, origin)
        end = int(score.argmax())
        if (int(score[end]), -end) > (best[0], -best[2]):
            best = (int(score[end]), int(origin[end]), end)
    return best


def _windows(places: np.ndarray, size: int, slack: int) -> list[tuple[int, int]]:
    """Stretches of the text around supposed starts of an item, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for place in np.unique(places).tolist():
        low, high = place - slack, place + size + slack
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _aligner(block: Block):
    rule = block.rule

    def hits(words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, item, supposed starts of the item in the row's words)."""
        rows, items, starts = [], [], []
        for width in block.widths:
            grams = _grams(words.hash, width)
            if not len(grams) or not len(block.seed):
                continue
            low = np.searchsorted(block.seed, grams)
            low = np.minimum(low, len(block.seed) - 1)
            at = np.flatnonzero(block.seed[low] == grams)
            at = at[words.row[at] == words.row[at + width - 1]]
            first, last = np.searchsorted(block.seed, grams[at]), np.searchsorted(block.seed, grams[at], "right")
            while len(at):
                rows.append(words.row[at])
                items.append(block.seed_item[first])
                starts.append(at - words.first[words.row[at]] - block.seed_place[first])
                first = first + 1
                more = first < last
                at, first, last = at[more], first[more], last[more]
        if not rows:
            return
        rows, items, starts = map(np.concatenate, (rows, items, starts))
        order = np.lexsort((items, rows))
        rows, items, starts = rows[order], items[order], starts[order]
        cuts = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(items, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            yield int(rows[a]), int(items[a]), starts[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = Words(batch.column("text"))
            found: list[tuple[int, int, int, int, int, float]] = []
            for row, item, starts in hits(words):
                query, text = block.items[item], words.of(row)
                possible = rule.match * len(query)
                best = (0, 0, 0)
                for low, high in _windows(starts, len(query), max(4, len(query) // 2)):
                    low = max(0, low)
                    score, start, end = local_alignment(query, text[low:high], rule)
                    if score > best[0]:
                        best = (score, low + start, low + end)
                if best[0] >= rule.coverage * possible:
                    found.append((row, block.ids[item], *best, best[0] / possible))
            if found:
                row, item, score, start, end, share = map(np.array, zip(*found, strict=True))
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (item, score, start, end, share))],
                    names=["doc_id", "item_id", "score", "start_word", "end_word", "coverage"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Alignment | None = None) -> DataFrame:
    """One row per document row and test item that it holds, edited copies included.

    Returns doc_id, item_id, score, start_word and end_word (word span of the
    best alignment in the document, end excluded) and coverage (score over that
    of a perfect copy). Null, empty and blank texts and items match nothing;
    items without an id take no part; a null doc_id stays null. Repeated rows
    are reported each; equal scores go to the span that comes first. Other
    columns are ignored, empty tables give no rows.
    """
    rule = rule or Alignment()
    texts = only(docs, "doc_id", "text")
    out = []
    for block in _blocks(benchmark, rule):
        if not len(block.words):
            continue
        sums = texts.select("text").mapInArrow(_counter(block), "place long, n long").groupBy("place").agg(
            F.sum("n").alias("n")
        )
        counts, total = np.zeros(len(block.words), np.int64), 0
        for row in sums.collect():  # one number per benchmark word of the block
            if row["place"] < 0:
                total = row["n"]
            else:
                counts[row["place"]] = row["n"]
        block.rare(counts, total)
        out.append(
            texts.mapInArrow(
                _aligner(block),
                "doc_id long, item_id long, score long, start_word long, end_word long, coverage double",
            )
        )
    if not out:
        return texts.limit(0).selectExpr(
            "doc_id", "0L item_id", "0L score", "0L start_word", "0L end_word", "0D coverage"
        )
    return reduce(DataFrame.unionByName, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Alignment | None = None) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows with a null doc_id stay."""
    bad = materialize(
        contamination(docs, benchmark, rule).where("doc_id is not null").select(F.col("doc_id").alias("bad_id")).distinct(),
        "leaks",
    )
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
