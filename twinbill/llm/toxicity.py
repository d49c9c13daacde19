"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of context windows.

Fitting, on at most ``sample_rows`` labelled rows: terms are whole words, or
stems (first letters of a word family), that toxic documents have far more
often than others; the lower end of a confidence interval decides. The terms
form a trie. Its intersection with the automata of edit distance one is made
deterministic once, on the driver; it has a few thousand states whatever the
size of the corpus.

Scoring, one pass without a shuffle: all words of a batch run through the
automaton together. Each hit counts by the share of toxic documents among
those with that kind of hit in the sample. Hits inside quotation marks are
counted apart, and the fullest window of ``window`` words tells a burst from
scattered mentions. A logistic regression over these features gives the score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LETTER, NUMBER, classes
from .scratch import only
from .text import column_bytes, row_of, spans, steps


@dataclass(frozen=True)
class ToxicityRule:
    sample_rows: int = 20_000
    terms: int = 128
    #: How far the lower bound of the share of toxic documents among those with a word, or a
    #: stem, must lie above the share among all, as a part of what is possible.
    least_lift: float = 0.4
    least_stem_lift: float = 0.15
    #: Least number of toxic documents of the sample that have a term.
    least_documents: int = 8
    confidence: float = 2.58
    #: Words shorter than this must match exactly; the first letter always must.
    edit_from: int = 5
    stem_letters: tuple[int, ...] = (4, 5, 6)
    window: int = 20
    ridge: float = 1e-4


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of every code point, and whether it may stand in a word."""
    kind = classes()
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(kind[:0x20000] == LETTER).tolist():
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    inside = (kind == LETTER) | (kind == NUMBER)
    inside[[ord(c) for c in "*@$"]] = True  # stand in for letters
    return lower, inside


_OPEN, _CLOSE, _STRAIGHT = "“„«‹", "”»›", '"'


def _before(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted ``places`` lie before each of ``at``; sums over a whole batch would hold eight bytes a
    character."""
    return np.searchsorted(places, at)


class Tokens:
    """Words of a batch by code points: span, row, and whether inside quotation marks."""

    def __init__(self, column: pa.Array):
        raw, offsets = column_bytes(column)
        self.offsets = offsets - _before(np.flatnonzero((raw & 0xC0) == 0x80), offsets)
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
        lower, inside = _folding()
        starts, ends = spans(inside[points], self.offsets)
        self.points = lower[points]
        del points
        marks = np.flatnonzero((self.points == 42) | (self.points == 64) | (self.points == 36))
        if len(marks):  # marks at either end belong to no word
            keep = _before(marks, ends) - _before(marks, starts) < ends - starts
            starts, ends = starts[keep], ends[keep]
            gap = np.diff(marks) > 1
            heads, tails = marks[np.concatenate([[True], gap])], marks[np.concatenate([gap, [True]])]
            run = np.minimum(_before(tails, starts), len(tails) - 1)
            starts = np.where((heads[run] <= starts) & (starts <= tails[run]), tails[run] + 1, starts)
            run = np.minimum(_before(tails, ends - 1), len(tails) - 1)
            ends = np.where((heads[run] < ends) & (ends - 1 <= tails[run]), heads[run], ends)
        self.starts, self.ends = starts, ends
        self.row = row_of(self.offsets, starts)
        self.first = np.searchsorted(self.row, np.arange(len(self.offsets)))

    def quoted(self, at: np.ndarray) -> np.ndarray:
        """For positions: whether a quotation is open there, counted from the start of the line."""
        p = self.points
        special = np.flatnonzero(np.isin(p, [10, *map(ord, _OPEN + _CLOSE + _STRAIGHT)]))
        if not len(special):
            return np.zeros(len(at), bool)
        kind = p[special]
        depth = np.cumsum(np.isin(kind, [ord(c) for c in _OPEN]).astype(int) - np.isin(kind, [ord(c) for c in _CLOSE]))
        straight = np.cumsum(kind == ord(_STRAIGHT))
        line = np.unique(np.concatenate([self.offsets[:-1], special[kind == 10] + 1]))
        start = line[np.searchsorted(line, at, side="right") - 1]
        value = lambda sums, x: np.concatenate([[0], sums])[np.searchsorted(special, x)]
        opened = value(depth, at) - value(depth, start)
        return (opened > 0) | ((value(straight, at) - value(straight, start)) % 2 == 1)

    def word(self, k: int) -> str:
        return self.points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


class Automaton:
    """Deterministic intersection of the lexicon trie with edit distance at most one.

    ``value[state]`` is -1, or twice the term's number plus one if it took an
    edit; the exact one wins, then the term named first.
    """

    def __init__(self, terms: list[str], edit_from: int):
        letters = sorted({c for t in terms for c in t.rstrip("~")})
        self.symbol = {ord(c): k + 1 for k, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends: list[dict[int, bool]] = [{}]  # node -> {term: may have an edit}
        for number, term in enumerate(terms):
            node = 0
            for c in term.rstrip("~"):
                k = self.symbol[ord(c)]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append({})
                node = children[node][k]
            ends[node][number] = not term.endswith("~") and len(term) >= edit_from
        stems = [{n for n in e if terms[n].endswith("~")} for e in ends]

        def closed(places: set[tuple[int, int]]) -> frozenset:
            """A letter of the term may be missing (one edit, never the first)."""
            more = {(c, 1) for node, e in places if e == 0 and node > 0 for c in children[node].values()}
            places = places | more
            best: dict[int, int] = {}
            for node, e in places:
                best[node] = min(e, best.get(node, 9))
            return frozenset(best.items())

        def value(places: frozenset) -> int:
            found = [-1]
            for node, e in places:
                if node < 0:
                    found.append(2 * (-node - 1))
                else:
                    found += [2 * n + e for n, loose in ends[node].items() if e == 0 or loose]
            good = [v for v in found if v >= 0]
            return min(good, key=lambda v: (v % 2, v)) if good else -1

        def step(places: frozenset, k: int) -> frozenset:
            out: set[tuple[int, int]] = set()
            for node, e in places:
                if node < 0:
                    out.add((node, 0))
                    continue
                out |= {(-n - 1, 0) for n in stems[node] if e == 0}
                if k in children[node]:
                    out.add((children[node][k], e))
                if e == 0 and node > 0:
                    out.add((node, 1))  # a letter too many
                    out |= {(c, 1) for c in children[node].values()}  # another letter
            return closed(out)

        start = closed({(0, 0)})
        number = {frozenset(): 0, start: 1}
        table = [[0] * (len(letters) + 1)]
        todo = [start]
        self.value = [-1]
        while todo:
            places = todo.pop(0)
            row = []
            for k in range(len(letters) + 1):
                to = step(places, k)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
            self.value.append(value(places))
        self.table, self.value = np.array(table, np.int32), np.array(self.value)

    def hits(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Words that match, and the value of each."""
        symbol = np.zeros(0x110000, np.uint8)
        for point, k in self.symbol.items():
            symbol[point] = k
        symbols = symbol[tokens.points]
        state = np.ones(len(tokens.starts), np.int32)
        live, at = np.arange(len(tokens.starts)), tokens.starts.copy()
        while len(live):
            state[live] = self.table[state[live], symbols[at]]
            on = (state[live] > 0) & (at + 1 < tokens.ends[live])
            live, at = live[on], at[on] + 1
        found = self.value[state]
        which = np.flatnonzero(found >= 0)
        return which, found[which]


FEATURES = 8


@dataclass
class Model:
    terms: list[str]
    #: By hit value: how much a hit counts.
    weight: np.ndarray
    rule: ToxicityRule
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    automaton: Automaton = None

    def features(self, batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows, and hits of each row."""
        tokens = Tokens(batch_text)
        rows = len(tokens.offsets) - 1
        out = np.zeros((rows, FEATURES))
        out[:, 0] = 1
        which, value = self.automaton.hits(tokens)
        row, worth = tokens.row[which], self.weight[value]
        quoted = tokens.quoted(tokens.starts[which])
        plain = np.bincount(row, worth * ~quoted, rows)
        words = np.diff(tokens.first)
        # Worth of the hits in the window that starts at each hit.
        sums = np.concatenate([[0.0], np.cumsum(worth * ~quoted)])
        end = np.minimum(np.searchsorted(which, which + self.rule.window), np.searchsorted(row, row, side="right"))
        burst = np.zeros(rows)
        np.maximum.at(burst, row, sums[end] - sums[: len(which)])
        pairs = np.unique(np.stack([row, value // 2]), axis=1)
        out[:, 1] = np.log1p(plain)
        out[:, 2] = np.log1p(np.bincount(row, worth * quoted, rows))
        out[:, 3] = np.log1p(burst)
        out[:, 4] = np.log1p(100 * plain / np.maximum(words, 20))
        out[:, 5] = np.log1p(np.bincount(pairs[0], minlength=rows))
        out[:, 6] = np.log1p(np.bincount(row, ~quoted, rows))
        out[:, 7] = np.log1p(words / 100)
        return out, np.bincount(row, minlength=rows)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -40, 40)))


def held_out(doc_id) -> F.Column:
    """Rows that no label may be learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(stems: tuple[int, ...]):
    """Documents of each label that have a word, or a word of a stem (marked by ~)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"))
            toxic = batch.column("toxic").to_pylist()
            for row, label in enumerate(toxic):
                words = {tokens.word(k) for k in range(tokens.first[row], tokens.first[row + 1])}
                words |= {w[:n] + "~" for w in words for n in stems if len(w) >= n}
                counts.update((w, label) for w in words)
            if len(counts) > 400_000:
                yield _count_rows(counts)
                counts.clear()
        yield _count_rows(counts)

    return run


def _count_rows(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([w for w, _ in counts], pa.string()),
            pa.array([n if label == 1 else 0 for (_, label), n in counts.items()], pa.int64()),
            pa.array([0 if label == 1 else n for (_, label), n in counts.items()], pa.int64()),
        ],
        names=["term", "toxic", "clean"],
    )


def _chosen(candidates: list, rule: ToxicityRule) -> list[str]:
    """Stems that say more than any one of their words, and words outside them."""
    toxic = {r["term"]: r["toxic"] for r in candidates}
    best_word: dict[str, int] = defaultdict(int)
    for term, n in toxic.items():
        if not term.endswith("~"):
            for k in rule.stem_letters:
                best_word[term[:k] + "~"] = max(best_word[term[:k] + "~"], n)
    out: list[str] = []
    for term in sorted((t for t in toxic if t.endswith("~")), key=lambda t: (len(t), t)):
        covered = any(term.startswith(s[:-1]) for s in out)
        if not covered and best_word[term] < 0.9 * toxic[term]:
            out.append(term)
    stems = tuple(s[:-1] for s in out)
    out += [t for t in toxic if not t.endswith("~") and not (stems and t.startswith(stems))]
    return sorted(out, key=lambda t: (-toxic[t], t))[: rule.terms]


def _sample(docs: DataFrame, labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    """At most about ``sample_rows`` labelled rows (text, toxic), picked by a hash of the id."""
    known = (
        only(labels, "doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, rule.sample_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    # Bounded by sample_rows: two numbers a row.
    return only(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rule: ToxicityRule | None = None) -> Model:
    """Lexicon and classifier. Without labels of both kinds all scores are one half or the base rate."""
    rule = rule or ToxicityRule()
    sample = _sample(docs, labels, rule)
    whole = sample.agg(F.avg("toxic")).first()[0] or 0.0
    n, z = F.col("toxic") + F.col("clean"), rule.confidence
    share = F.col("toxic") / n
    low = (
        share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)
    ) / (1 + z * z / n)
    found = (
        sample.mapInArrow(_word_counts(rule.stem_letters), "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= rule.least_documents)
        .where(
            low >= whole + (1 - whole) * F.when(F.col("term").endswith("~"), rule.least_stem_lift).otherwise(rule.least_lift)
        )
        .orderBy(F.desc("toxic"), "term")
        .limit(20 * rule.terms)  # of a sample of bounded size
        .collect()
    )
    model = Model(_chosen(found, rule), np.ones(0), rule)
    model.automaton = Automaton(model.terms, rule.edit_from)
    model.weight = np.ones(2 * len(model.terms))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"))
            which, value = model.automaton.hits(tokens)
            both = np.unique(np.stack([tokens.row[which], value]), axis=1)
            label = np.asarray(batch.column("toxic"))[both[0]]
            yield pa.record_batch(
                [pa.array(both[1]), pa.array(label.astype(np.int64)), pa.array(np.ones(len(label), np.int64))],
                names=["value", "toxic", "n"],
            )

    seen = (
        sample.mapInArrow(kinds, "value long, toxic long, n long")
        .groupBy("value")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .collect()
    )  # two rows a term at most
    by_kind = {r["value"]: (r["toxic"], r["n"]) for r in seen}
    for value in range(len(model.weight)):
        toxic, n = by_kind.get(value, (0, 0))
        # Share above that of all documents; misspellings not in the sample count for most of the term.
        lift = max(0.0, (toxic + 1) / (n + 2) - whole) / max(1 - whole, 1e-9)
        model.weight[value] = 0.7 * model.weight[value - 1] if value % 2 and not n else lift

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x, _ = model.features(batch.column("text"))
            yield pa.record_batch(
                [*[pa.array(x[:, k]) for k in range(1, FEATURES)], batch.column("toxic").cast(pa.int64())],
                names=[f"x{k}" for k in range(1, FEATURES)] + ["toxic"],
            )

    fields = ", ".join(f"x{k} double" for k in range(1, FEATURES))
    data = np.array(sample.mapInArrow(rows, f"{fields}, toxic long").collect(), float).reshape(-1, FEATURES)
    x = np.concatenate([np.ones((len(data), 1)), data[:, :-1]], axis=1)
    model.coefficients = _logistic(x, data[:, -1], rule.ridge)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the intercept is not penalised."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    # An even order of rows makes sums, and so the result, the same in every run.
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) / len(y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty
        move = np.linalg.solve(hessian, gradient)
        w = w - move / max(1.0, np.abs(move).max() / 2)
        if np.abs(gradient).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, hits (words that match a term), score and predicted of each row's whole text.

    Null and empty texts have no hits and get the score of such. Null ids stay
    null, rows may repeat, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x, hits = model.features(batch.column("text"))
            p = model.score(x)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(hits), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "hits", "score", "predicted"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, hits long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rule: ToxicityRule | None = None) -> DataFrame:
    """``score`` of a model fitted on the labels that may be learned from, with held_out."""
    out = score(docs, fit(docs, labels, rule))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def reject_toxic(docs: DataFrame, labels: DataFrame, rule: ToxicityRule | None = None) -> DataFrame:
    """``docs`` without the rows that are predicted toxic. Columns keep names and order."""
    model = fit(docs, labels, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x, _ = model.features(batch.column("text"))
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)
