"""Language identification by averaged embeddings of hashed subwords.

A text is lower-cased and everything but letters becomes one space. Every run of
2, 3 or 4 bytes of a word with the spaces around it, and every whole word, is a
subword. Subwords are hashed to rows of an embedding table; the mean of a text's
rows goes through a linear softmax with one output a language.

Fitting, on a bounded sample of labelled documents whose features tasks have
counted: minibatch gradient descent in numpy with a falling rate, on one part of the sample;
on the other part a temperature is chosen that makes the scores true probabilities
(least cross-entropy), and the least score at which accepted answers reach the wanted
precision. Texts below that score are marked as rejected.

Scoring is one scan: whole texts, all subwords, the model goes along with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, only
from .text import U, column_bytes, hash_spans, mix, spans, steps

UNDETERMINED = "und"
SPACE = 32
LETTER = r"\pL"
#: Bytes of text whose subwords are made at once, and embeddings that are summed at once.
WINDOW = 1 << 20
GATHERED = 1 << 17


@dataclass(frozen=True)
class LanguageRule:
    """``sample_rows`` labelled documents at most to fit on, of them ``least_rows`` of a language where it has
    so many; ``languages`` at most, the most frequent ones; size of the table; steps of training (a smaller
    sample is gone through more often); share of correct answers among accepted ones."""

    sample_rows: int = 8_000
    least_rows: int = 400
    languages: int = 500
    buckets: int = 1 << 16
    width: int = 16
    updates: int = 1000
    batch: int = 32
    rate: float = 0.5
    wanted_precision: float = 0.99
    seed: int = 7


@dataclass
class LanguageModel:
    """Languages in order of name, embedding table, softmax, temperature and least accepted score."""

    rule: LanguageRule
    names: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    least_score: float = 0.0

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """A row for each text; texts without a subword get the softmax of the bias."""
        sums, sizes = np.zeros((len(column), self.rule.width)), np.zeros(len(column))
        for bucket, owner in subwords(column, self.rule.buckets):
            for low in range(0, len(bucket), GATHERED):
                own = owner[low : low + GATHERED]
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[heads]] += np.add.reduceat(self.table[bucket[low : low + GATHERED]], heads, axis=0)
            sizes += np.bincount(owner, minlength=len(sizes))
        means = sums / np.maximum(1, sizes)[:, None]
        return softmax((means @ self.weights.T + self.bias) / self.temperature)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def letters_only(column: pa.Array) -> pa.Array:
    """Texts in lower case with one space for each run of other characters, and at both ends."""
    words = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), r"\PL+", " ")
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, pc.utf8_trim(words, " "), space, pa.scalar("", pa.large_string()))


def subwords(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all subwords of a batch of texts, in pieces of bounded size, each in order of the texts."""
    raw, offsets = column_bytes(letters_only(column))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for low in range(0, len(raw), WINDOW):
        size = min(WINDOW, len(raw) - low)
        part = np.zeros(size + 3, np.uint8)
        seen = raw[low : low + size + 3]
        part[: len(seen)] = seen
        space, part, owner = part == SPACE, part.astype(U), row[low : low + size]
        left = offsets[1:][owner] - np.arange(low, low + size)
        # a run may begin and end with a space, never hold one inside, and not cross a text's end
        gram, inside = part[:size], ~(space[:size] & space[1 : size + 1])
        for k in (1, 2, 3):
            gram = gram | (part[k : k + size] << U(8 * k))
            whole = inside & (left > k)
            yield (mix(gram[whole] + (U(k) << U(40))) % U(buckets)).astype(np.int64), owner[whole]
            inside &= ~space[k : k + size]
    starts, ends = spans(raw != SPACE, offsets)
    for low in range(0, len(starts), WINDOW):
        first, last = starts[low : low + WINDOW], ends[low : low + WINDOW]
        yield (hash_spans(raw, first, last) % U(buckets)).astype(np.int64), row[first]


def _sample(docs: DataFrame, rule: LanguageRule) -> tuple[list[str], DataFrame]:
    """Languages and at most about ``sample_rows`` documents (text, label, weight), picked by a hash of the text.

    Frequent languages are thinned out to one share, rarer ones keep
    ``least_rows``; the weight undoes that.
    """
    known = only(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rule.languages).collect()
    counts = {r["lang"]: r["count"] for r in counts}
    total = sum(counts.values())
    least = min(rule.least_rows, rule.sample_rows // max(1, 2 * len(counts)))
    base = rule.sample_rows / 2 / max(1, total)
    rates = {lang: min(1.0, max(base, least / n)) for lang, n in counts.items()}
    if total <= rule.sample_rows:
        rates = dict.fromkeys(counts, 1.0)
    spark = docs.sparkSession
    names = sorted(counts)
    # one row a language
    plan = spark.createDataFrame(
        [(lang, k, rates[lang], 1.0 / rates[lang]) for k, lang in enumerate(names)],
        "lang string, label long, rate double, weight double",
    )
    pick = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    picked = known.join(F.broadcast(plan), "lang").where(pick)
    return names, picked.select("text", "label", "weight", F.xxhash64("text").alias("at"))


def _features(sample: DataFrame, buckets: int) -> DataFrame:
    """Counted buckets of each sampled text, as packed binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            pieces = [owner.astype(np.int64) * buckets + bucket for bucket, owner in subwords(batch.column("text"), buckets)]
            keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *pieces]), return_counts=True)
            edges = np.searchsorted(keys, np.arange(batch.num_rows + 1) * buckets)
            bucket, count = (keys % buckets).astype("<u4"), counts.astype("<u4")
            yield pa.record_batch(
                [
                    pa.array([bucket[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    *[batch.column(c) for c in ("label", "weight", "at")],
                ],
                names=["bucket", "counts", "label", "weight", "at"],
            )

    return sample.mapInArrow(run, "bucket binary, counts binary, label long, weight double, at long")


def _descend(rows: list, labels: np.ndarray, weights: np.ndarray, languages: int, rule: LanguageRule):
    """Embedding table, softmax weights and bias by minibatch gradient descent.

    Texts are dealt to batches once, and batches are shuffled in every epoch, so
    a batch is one small dense matrix of texts by the buckets they hold.
    """
    rng = np.random.default_rng(rule.seed)
    table = rng.uniform(-1, 1, (rule.buckets, rule.width)) / rule.width
    out, bias = np.zeros((languages, rule.width)), np.zeros(languages)
    weights = weights / weights.mean()
    order = rng.permutation(len(rows))
    batches = []
    for start in range(0, len(order), rule.batch):
        part = order[start : start + rule.batch]
        held, place = np.unique(np.concatenate([rows[k][0] for k in part]), return_inverse=True)
        own = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
        batches.append((part, held, own, place, np.concatenate([rows[k][1] for k in part])))
    done, epochs = 0, -(-rule.updates // max(1, len(batches)))
    every = epochs * max(1, len(batches))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            part, held, own, place, share = batches[k]
            rate = rule.rate * (1 - done / every)
            texts = np.zeros((len(part), len(held)))
            texts[own, place] = share
            hidden = texts @ table[held]
            error = softmax(hidden @ out.T + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error *= weights[part][:, None]
            table[held] -= rate * (texts.T @ (error @ out))
            out -= rate * error.T @ hidden
            bias -= rate * error.sum(axis=0) / len(part)
            done += 1
    return table.astype(np.float32), out.astype(np.float32), bias.astype(np.float32)


def _temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Divisor of the logits with the least weighted cross-entropy, on a logarithmic grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    at = np.arange(len(labels))
    loss = [-(weights * np.log(softmax(logits / t)[at, labels] + 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _least_score(score: np.ndarray, right: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """Smallest score such that the answers from it on are right in the wanted share; above 1 where none is."""
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum((right * weights)[order]) / np.cumsum(weights[order])
    # equal scores are accepted together
    last = np.append(np.diff(score[order]) != 0, True)
    good = np.flatnonzero((precision >= wanted) & last)
    return float(score[order][good[-1]]) if len(good) else 1.01


def fit(docs: DataFrame, rule: LanguageRule | None = None) -> LanguageModel:
    """Model of the documents that may be learned from.

    Documents without text or language teach nothing. Without any the model
    has no language and answers ``und``. One text under several languages
    counts for each of them.
    """
    rule = rule or LanguageRule()
    names, sample = _sample(docs, rule)
    model = LanguageModel(rule, names)
    if not names:
        return model
    # Bounded by sample_rows times the buckets of a text.
    data = materialize(_features(sample, rule.buckets), "features").orderBy("at", "label").toPandas()
    rows = []
    for bucket, counts in zip(data["bucket"], data["counts"], strict=True):
        n = np.frombuffer(counts, "<u4").astype(float)
        rows.append((np.frombuffer(bucket, "<u4").astype(np.int64), n / max(1.0, n.sum())))
    labels, weights = data["label"].to_numpy(), data["weight"].to_numpy()
    tune = data["at"].to_numpy() % 5 == 0
    if tune.all() or not tune.any():
        tune = np.zeros(len(rows), dtype=bool)
    learn = np.flatnonzero(~tune)
    model.table, model.weights, model.bias = _descend(
        [rows[k] for k in learn], labels[learn], weights[learn], len(names), rule
    )
    check = np.flatnonzero(tune) if tune.any() else learn
    if not len(check):
        return model
    hidden = np.stack([(model.table[b] * s[:, None]).sum(axis=0) for b, s in (rows[k] for k in check)])
    logits = hidden @ model.weights.T + model.bias
    model.temperature = _temperature(logits, labels[check], weights[check])
    p = softmax(logits / model.temperature)
    model.least_score = _least_score(p.max(axis=1), p.argmax(axis=1) == labels[check], weights[check], rule.wanted_precision)
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row's whole text.

    Null texts and those without a letter are ``und`` with score 0 and rejected;
    so is everything if the model has no language. Equal scores go to the first
    language by name. Null ids stay null, rows may repeat, other columns are
    ignored.
    """
    names = pa.array([*model.names, UNDETERMINED], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            text = batch.column("text")
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, LETTER), False))
            best = np.full(batch.num_rows, len(model.names))
            score = np.zeros(batch.num_rows)
            if model.names:
                p = model.probabilities(text)
                best = np.where(letters, p.argmax(axis=1), best)
                score = np.where(letters, p.max(axis=1), 0.0)
            rejected = (best == len(model.names)) | (score < model.least_score)
            yield pa.record_batch(
                [batch.column("doc_id"), names.take(pa.array(best)), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, rule: LanguageRule | None = None) -> DataFrame:
    """``predict`` with a model fitted on the rows of ``docs`` that may be learned from, with held_out."""
    out = predict(docs, fit(docs, rule))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
