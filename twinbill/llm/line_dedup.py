"""Line dedup by pairwise alignment of overlapping documents.

1. Every line becomes a 64-bit hash; equal texts form a class with the smallest
   doc_id as its document. A line belongs to the smallest document that has it.
2. A run is the fewest neighbouring lines with ``min_words`` words, counted on
   from a line or back from it; a long line is its own run. Runs have owners
   as lines have. A later document meets the owner of each run it repeats,
   however many documents hold the run: every block that could be deleted
   contains a run, so shorter lines bring no documents together and the size
   of the corpus plays no part. One row per document and owner, so a group of
   any size gives no pairs inside itself. Rows of an owner that many documents
   meet are dealt to several tasks.
3. Patience diff aligns the two documents: lines that occur once in both anchor
   it, of those that cross the chain with the most words, equal neighbours
   extend it, and the gaps are aligned in the same way; where no line occurs
   once, the first of a line goes with the first. Runs of aligned lines with at
   least ``min_words`` words are deleted from the later document, and so are its
   further copies of them.
   The owner keeps them, since no earlier document has them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, only
from .text import IS_SPACE, U, chain, column_bytes, hash_spans, mix, row_of, signed, spans, steps

_BASE = U(0xD6E8FEB86659FD93)

@dataclass(frozen=True)
class LineDedup:
    """``min_words``: the fewest words of a block that is deleted."""

    min_words: int = 8


#: Documents with one run that a task aligns with its owner, about.
_PART = 256


def runs(lines: np.ndarray, words: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of two or more lines; ``edges`` are the first lines of the rows and the end."""
    n = len(lines)
    if n == 0:
        return np.empty(0, U), np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    short = np.flatnonzero((words > 0) & (words < least))
    # On from a line to the first line that fills the run, and back from a line in the same way.
    on = np.searchsorted(total, total[short] + least)
    back = np.searchsorted(total, total[short + 1] - least, side="right") - 1
    first = np.concatenate([short[on <= edges[row[short] + 1]], back[back >= edges[row[short]]]])
    stop = np.concatenate([on[on <= edges[row[short] + 1]], short[back >= edges[row[short]]] + 1])
    # Prefix sums of a polynomial hash modulo 2^64; the base is odd, so its powers can be divided out.
    power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, U(pow(int(_BASE), -1, 2**64)))]))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(lines) * power)])
    return chain((sums[stop] - sums[first]) * inverse[first], (stop - first).astype(U)), row[first]


def _lines(batches: Iterator[pa.RecordBatch], rule: LineDedup) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        raw, offsets = column_bytes(batch.column("text"))
        rows = len(offsets) - 1
        # Each newline ends a line, and so does the end of a text.
        newlines = np.flatnonzero(raw == 10)
        stops = np.concatenate([newlines, offsets[1:]])
        owner = np.concatenate([row_of(offsets, newlines), np.arange(rows)])
        order = np.lexsort((stops, owner))
        stops, owner = stops[order], owner[order]
        new = np.diff(owner, prepend=-1) != 0
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
        starts[new] = offsets[:-1][owner[new]]
        word_starts, _ = spans(~IS_SPACE[raw], offsets)
        words = np.searchsorted(word_starts, stops) - np.searchsorted(word_starts, starts)
        edges = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
        lists = lambda x, at=edges: pa.ListArray.from_arrays(pa.array(at), pa.array(x))
        hashes = hash_spans(raw, starts, stops)
        found, at = runs(hashes, words, edges, rule.min_words)
        found = found[np.argsort(at, kind="stable")]
        run_edges = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]).astype(np.int32)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                lists(signed(hashes)),
                lists(words.astype(np.int32)),
                lists(signed(found), run_edges),
            ],
            names=["doc_id", "digest", "lines", "words", "runs"],
        )


def _heaviest(common: list[tuple[int, int]], weight: list[int]) -> list[tuple[int, int]]:
    """Anchors, increasing on the left, whose right sides increase too and weigh most."""
    if all(x[1] < y[1] for x, y in zip(common, common[1:])):
        return common
    rank = {j: r for r, j in enumerate(sorted(j for _, j in common), 1)}
    # Fenwick tree over ranks: heaviest chain that ends at or before a rank, and its last anchor.
    best = [(0, -1)] * (len(rank) + 1)

    def up_to(r: int) -> tuple[int, int]:
        top = (0, -1)
        while r:
            top = max(top, best[r])
            r &= r - 1
        return top

    before = []
    for k, (_, j) in enumerate(common):
        total, last = up_to(rank[j] - 1)
        before.append(last)
        r, own = rank[j], (total + weight[j], k)
        while r < len(best):
            best[r] = max(best[r], own)
            r += r & -r
    chain, k = [], up_to(len(rank))[1]
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    return chain[::-1]


def patience(left: list[int], right: list[int], words: list[int] | None = None) -> list[tuple[int, int]]:
    """Matched index pairs, increasing in both; ``words`` weigh the right lines (all alike). The same for every run."""
    words = words or [1] * len(right)
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        count_left, count_right = Counter(left[a:b]), Counter(right[c:d])
        place = {right[j]: j for j in range(c, d) if count_right[right[j]] == 1}
        common = [(i, place[left[i]]) for i in range(a, b) if count_left[left[i]] == 1 and left[i] in place]
        if not common:
            # Nothing occurs once on both sides: the first of a line goes with the first, the second with the second.
            nth: Counter[int] = Counter()
            places = {}
            for j in range(c, d):
                places[right[j], nth[right[j]]] = j
                nth[right[j]] += 1
            nth.clear()
            for i in range(a, b):
                if (left[i], nth[left[i]]) in places:
                    common.append((i, places[left[i], nth[left[i]]]))
                nth[left[i]] += 1
        chain = _heaviest(common, words)
        if chain:
            for (i, j), (x, y) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
                todo.append((i + 1, x, j + 1, y))
            out += chain
    return sorted(out)


def _run_ends(words: list[int], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Fewest lines in ``low:high`` with ``least`` words, on from each line with words and back from each."""
    i, total = low, 0
    for j in range(low, high):
        total += words[j]
        while total >= least:
            if words[i] > 0:
                yield i, j + 1
            total -= words[i]
            i += 1
    i, total = high - 1, 0
    for j in range(high - 1, low - 1, -1):
        total += words[j]
        while total >= least:
            if words[i] > 0:
                yield j, i + 1
            total -= words[i]
            i -= 1


def further_copies(lines: list[int], words: list[int], cuts: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Parts of ``lines`` between the cuts that repeat part of a cut with ``least`` words or more; no part of a cut is given."""
    if not cuts:
        return []
    known = {tuple(lines[i:j]) for low, high in cuts for i, j in _run_ends(words, least, low, high)}
    gone = {line for low, high in cuts for line in lines[low:high]}
    rest, at = [], 0
    for low, high in [*cuts, (len(lines), len(lines))]:
        # Only neighbours that all occur in cuts can repeat one.
        k = at
        while k < low:
            start = k
            while k < low and lines[k] in gone:
                k += 1
            if k > start:
                rest += [(i, j) for i, j in _run_ends(words, least, start, k) if tuple(lines[i:j]) in known]
            k += 1
        at = high
    return _merged(rest)


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(parts):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _aligned(matched: list[tuple[int, int]], words: list[int], least: int) -> list[tuple[int, int]]:
    """Right sides of the runs of neighbouring matches with ``least`` words or more."""
    out, start = [], 0
    for k in range(1, len(matched) + 1):
        if k == len(matched) or matched[k] != (matched[k - 1][0] + 1, matched[k - 1][1] + 1):
            low, high = matched[start][1], matched[k - 1][1] + 1
            if sum(words[low:high]) >= least:
                out.append((low, high))
            start = k
    return out


def _blocks(rule: LineDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few rows at a time as Python objects: owners can be long.
        for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            cut: list[list[dict]] = []
            names = ("owner_lines", "lines", "words")
            for owner, lines, words in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                found = _aligned(patience(owner, lines, words), words, rule.min_words)
                found += further_copies(lines, words, found, rule.min_words)
                cut.append([{"low": low, "high": high} for low, high in found])
            yield pa.record_batch(
                [batch.column("digest"), pa.array(cut, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))],
                names=["digest", "cuts"],
            )

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, cuts in zip(batch.column("n").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for cut in cuts:
                keep[cut["low"] : cut["high"]] = False
            out.append(keep.tolist())
        yield pa.record_batch(
            [batch.column("digest"), pa.array(out, pa.list_(pa.bool_()))], names=["digest", "keep"]
        )


def overlaps(lines: DataFrame, rule: LineDedup) -> DataFrame:
    """``(digest, owner, parts)`` of distinct texts: pairs of a later text and an earlier one it overlaps.

    ``parts`` is the number of tasks, a power of two, that share the rows of the owner with this number.
    """
    single = F.transform(
        F.filter(F.arrays_zip("lines", "words"), lambda x: x["words"] >= rule.min_words), lambda x: x["lines"]
    )
    seen = lines.select("digest", "doc_id", F.explode(F.array_distinct(F.concat(single, "runs"))).alias("run"))
    # Written, so that the join below has its own exchange and a hot run can be dealt to several tasks.
    owner = materialize(
        seen.groupBy("run")
        .agg(F.min(F.struct("doc_id", "digest")).alias("owner"), F.count("*").alias("texts_with"))
        .where("texts_with > 1")
        .select("run", F.col("owner.digest").alias("owner"), "texts_with"),
        "run-owners",
    )
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("texts_with") / _PART, F.lit(1.0))))).cast("int")
    return (
        seen.join(owner, "run")
        .where("owner <> digest")
        .groupBy("digest", "owner")
        .agg(F.max("texts_with").alias("texts_with"))
        .select("digest", "owner", parts.alias("parts"))
    )


def line_dedup(docs: DataFrame, rule: LineDedup | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with repeated blocks taken out of later documents.

    Adds ``n_lines`` and ``removed_lines`` (long) and replaces ``text`` by the
    lines that stay, joined by newlines. "Later" goes by doc_id. A text equal
    to that of a smaller doc_id loses all its lines, if it has ``min_words``
    words. Rows that repeat both id and text share one result. A null or empty
    text has one empty line and keeps it (null stays null); rows with a null
    doc_id take no part and keep their text. Columns named n_lines or
    removed_lines are replaced. An empty table gives no rows.
    """
    rule = rule or LineDedup()
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    lines = materialize(
        only(docs, "doc_id", "text")
        .where("doc_id is not null")
        .withColumn("digest", digest)
        .mapInArrow(
            lambda batches: _lines(batches, rule),
            "doc_id long, digest binary, lines array<long>, words array<int>, runs array<long>",
        ),
        "lines",
    )
    first = lines.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    texts = materialize(lines.join(first, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"]), "texts")

    pairs = materialize(overlaps(texts, rule), "line-pairs")
    own = texts.select("digest", "lines", "words")
    earlier = (
        pairs.select("owner", "parts")
        .distinct()
        .join(texts.select(F.col("digest").alias("owner"), F.col("lines").alias("owner_lines")), "owner")
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    )
    cuts = (
        pairs.withColumn("part", F.expr("cast(pmod(xxhash64(digest), parts) as int)"))
        .join(own, "digest")
        .join(earlier, ["owner", "parts", "part"])
        .select("digest", "owner_lines", "lines", "words")
        .mapInArrow(_blocks(rule), "digest binary, cuts array<struct<low:int,high:int>>")
        .where("size(cuts) > 0")
    )
    keep = (
        cuts.groupBy("digest")
        .agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
        .join(texts.select("digest", F.size("lines").alias("n")), "digest")
        .mapInArrow(_masks, "digest binary, keep array<boolean>")
    )
    enough = F.aggregate("words", F.lit(0), lambda s, w: s + w) >= rule.min_words
    # Copies of an earlier text lose all; first texts lose what the masks say.
    whole = (
        lines.join(first.withColumnRenamed("doc_id", "first_id"), "digest")
        .where((F.col("doc_id") > F.col("first_id")) & enough)
        .select("doc_id", "digest", F.lit(None).cast("array<boolean>").alias("keep"))
    )
    part = texts.select("doc_id", "digest").join(keep, "digest").select("doc_id", "digest", "keep")
    verdict = materialize(whole.unionByName(part).distinct(), "line-verdicts").select(
        F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest"), "keep", F.lit(True).alias("cut")
    )
    others = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    joined = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), digest.alias("text_digest")
    ).join(verdict, (F.col("row.doc_id") == F.col("cut_id")) & (F.col("text_digest") == F.col("cut_digest")), "left")
    text = F.col("row.text")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.filter(split, lambda _, i: F.element_at("keep", i + 1))
    untouched, empty = F.col("cut").isNull(), F.col("keep").isNull()
    stay = F.when(untouched, text).when(empty, F.lit("")).otherwise(F.array_join(kept, "\n"))
    gone = (
        F.when(untouched, 0).when(empty, F.size(split)).otherwise(F.size(F.filter("keep", lambda k: ~k)))
    )
    return joined.select(
        *[stay.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in others],
        F.size(split).cast("long").alias("n_lines"),
        gone.cast("long").alias("removed_lines"),
    )
