"""Bigram language model by deleted interpolation.

The probability of a word after another mixes the maximum-likelihood estimate
of the pair with the add-one estimate of the word alone. The weight depends on
how often the first word occurred in training (buckets by powers of two); it is
learned by expectation-maximisation on the held-out counts of a tuning fold:
estimates then come from the training rows outside that fold, and the counts
of its own pairs say how well each estimate foretold them. Scores use all
training rows.

Counts of words and pairs of the whole corpus live in hash shards
(``exchange``); no table of them reaches the driver or one task. The driver sees
totals and a histogram over (bucket, ratio of the two estimates), whose size
does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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
from .text import U, Words, chain

END, START = U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47)
WORD, PAIR = 0, 1


@dataclass(frozen=True)
class Folds:
    """Rows by crc32 of the id as text: ``held_out`` of ``outer`` is never learned from, ``tuning`` sets the weights."""

    outer: int = 7
    held_out: int = 2
    tuning: int = 5


class BlockTokens:
    """Words of a block, each text closed by the end token, as indexes into sorted keys."""

    def __init__(self, block: Block, folds: Folds):
        words, sizes = [], []
        for _, column in block.parts():
            part = Words(column)
            words.append(part.hash)
            sizes.append(np.diff(part.first))
        count = np.concatenate(sizes) + 1
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        tokens = np.full(self.ends[-1], END)
        inside = np.ones(len(tokens), bool)
        inside[self.ends - 1] = False
        tokens[inside] = np.concatenate(words)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        self.size = count
        self.train = block.fold != folds.held_out
        self.tune = block.fold == folds.tuning
        in_train, in_tune = np.repeat(self.train, count), np.repeat(self.tune, count)

        # START counts as a context, once for each text; it is no token.
        self.word_keys, index = np.unique(np.append(tokens, START), return_inverse=True)
        self.word = index[:-1]
        self.start = index[-1]
        self.previous = np.empty_like(self.word)
        self.previous[1:] = self.word[:-1]
        self.previous[self.starts] = self.start
        self.pair_keys, self.pair = np.unique(chain(before, tokens), return_inverse=True)
        tally = lambda index, n, mask: np.bincount(index[mask], minlength=n).astype(np.uint32)
        n_words, n_pairs = len(self.word_keys), len(self.pair_keys)
        self.word_counts = [tally(self.word, n_words, in_train), tally(self.word, n_words, in_tune)]
        self.word_counts[0][self.start] = self.train.sum()
        self.word_counts[1][self.start] = self.tune.sum()
        self.pair_counts = [tally(self.pair, n_pairs, in_train), tally(self.pair, n_pairs, in_tune)]


def _questions(folds: Folds, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            t = BlockTokens(block, folds)
            rows = [
                *question_rows(block.block, WORD, t.word_keys, t.word_counts, bits),
                *question_rows(block.block, PAIR, t.pair_keys, t.pair_counts, bits),
            ]
            for start in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist(rows[start : start + 512], schema=_QUESTIONS)

    return run


_QUESTIONS = pa.schema(
    [
        ("shard", pa.int32()),
        ("kind", pa.int32()),
        ("block", pa.int64()),
        ("keys", pa.binary()),
        ("values", pa.list_(pa.binary())),
    ]
)


def _sums(kind: int, _: list[int], keys: list[np.ndarray], values: list[list[bytes]]):
    """Counts over all blocks; totals are tokens and types in training, and without the tuning fold."""
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [
        np.bincount(index, np.concatenate([unpacked(v[k], np.uint32) for v in values]), len(every)).astype(np.uint64)
        for k in (0, 1)
    ]
    out, at = [], 0
    for own in keys:
        part = index[at : at + len(own)]
        out.append([sums[0][part], sums[1][part]])
        at += len(own)
    token = every != START
    rest = sums[0] - sums[1]
    return out, [
        int(sums[0][token].sum()), int((sums[0][token] > 0).sum()), int(rest[token].sum()), int((rest[token] > 0).sum())
    ]


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two at or below its count."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


#: Steps of the ratio histogram to a doubling.
_FINE = 256


def _tuning(folds: Folds, tokens: int, types: int):
    schema = pa.schema([("bucket", pa.int64()), ("ratio", pa.int64()), ("n", pa.int64())])

    def work(block: Block, rows: list[dict]) -> pa.Table:
        t = BlockTokens(block, folds)
        word = [x.astype(np.int64) for x in collected(rows, WORD, [np.uint64] * 2)]
        pair = [x.astype(np.int64) for x in collected(rows, PAIR, [np.uint64] * 2)]
        words, pairs = word[0] - word[1], pair[0] - pair[1]
        context = words[t.previous]
        seen = (context > 0) & np.repeat(t.tune, t.size)
        context, both, alone = context[seen], pairs[t.pair][seen], words[t.word][seen]
        with np.errstate(divide="ignore"):
            ratio = np.log2(both / context) - np.log2((alone + 1) / (tokens + types + 1))
        code = np.where(both > 0, np.round(np.where(both > 0, ratio, 0) * _FINE), -(1 << 30)).astype(np.int64)
        found, n = np.unique(np.stack([_bucket(context), code]), axis=1, return_counts=True)
        return pa.table([found[0], found[1], n], schema=schema)

    return work, "bucket long, ratio long, n long"


def mixture_weights(histogram: list[tuple[int, int, int]]) -> np.ndarray:
    """Weight of the pair estimate by bucket, from (bucket, ratio code, count); unseen buckets weigh nothing."""
    weights = np.zeros(66)
    for bucket in sorted({b for b, _, _ in histogram}):
        own = sorted((code, n) for b, code, n in histogram if b == bucket)
        code = np.array([c for c, _ in own])
        n = np.array([k for _, k in own], float)
        ratio = np.where(code <= -(1 << 29), 0.0, 2.0 ** (np.maximum(code, -(1 << 15)) / _FINE))
        weight = 0.5
        for _ in range(500):
            share = weight * ratio / (weight * ratio + 1 - weight)
            new = min(float((n * share).sum() / n.sum()), 1 - 1e-9)
            done, weight = abs(new - weight) < 1e-12, new
            if done:
                break
        weights[bucket] = weight
    return weights


def _scoring(folds: Folds, weights: np.ndarray, tokens: int, types: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def work(block: Block, rows: list[dict]) -> pa.Table:
        t = BlockTokens(block, folds)
        words = collected(rows, WORD, [np.uint64] * 2)[0].astype(np.int64)
        pairs = collected(rows, PAIR, [np.uint64] * 2)[0].astype(np.int64)
        count, context = words[t.word], words[t.previous]
        alone = (count + 1) / (tokens + types + 1)
        weight = weights[_bucket(context)]
        mixed = weight * pairs[t.pair] / np.maximum(context, 1) + (1 - weight) * alone
        per_text = lambda x: np.add.reduceat(x, t.starts)
        return pa.table(
            [
                block.doc_ids(),
                pa.array(~t.train),
                pa.array(t.size),
                pa.array(per_text((count > 0).astype(np.int64))),
                pa.array(np.full(len(t.size), tokens)),
                pa.array(per_text(np.log10(alone))),
                pa.array(per_text(np.log10(mixed))),
            ],
            schema=schema,
        )

    return work, (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def lm_scores(docs: DataFrame, folds: Folds | None = None) -> DataFrame:
    """Score of every whole text of ``docs`` (doc_id, text), one row per row.

    Tokens are lower-cased words and one end token; a null or empty text is the
    end token alone. Returns doc_id, held_out, n_tokens, n_known (tokens seen
    in training), train_tokens, base_score (add-one word model) and score, both
    log10 probabilities. A null doc_id stays null and is learned from, rows
    may repeat, other columns are ignored, an empty table gives no rows. If no
    row can be learned from, both scores are those of a uniform guess.
    """
    folds = folds or Folds()
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds.outer, F.lit(-1))
    table = blocks(docs, fold, fold == folds.tuning)
    bits = shard_bits(table, 0.13)
    answer = answers(table.mapInArrow(_questions(folds, bits), QUESTION_SCHEMA), _sums)
    totals = answer.where(f"block = -1 and kind = {WORD}").agg(
        *[F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)).alias(f"t{k}") for k in range(4)]
    ).first()
    tokens, types, tune_tokens, tune_types = totals
    histogram = (
        with_answers(table.where("special"), answer, *_tuning(folds, tune_tokens, tune_types))
        .groupBy("bucket", "ratio")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    weights = mixture_weights([tuple(r) for r in histogram])
    return with_answers(table, answer, *_scoring(folds, weights, tokens, types))
