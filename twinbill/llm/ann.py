"""Approximate nearest neighbours by multi-index hashing.

Fitting, on at most ``sample_rows`` vectors: several rotations, each learned so
that the signs of the rotated vectors lose as little as possible (alternating
between codes and the orthogonal matrix that fits them best). All signs
together are a vector's binary code.

Index: vectors go to shards of about ``shard_rows`` rows by a hash of the id.
A shard cuts its codes into substrings of 16 bits and has a table for each.

Search: every block of queries visits every shard. Codes that share a substring
within t bits are found by probing all values that differ in at most t bits. If two
codes differ in fewer than ``substrings * (t + 1)`` bits, one of the substrings
differs in at most t (pigeonhole), so after step t all codes within that radius
are known. t grows until the radius holds ``rerank_share`` of the shard; every code
within the radius of that many is ranked by the exact cosine. The best k of each
shard are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Bits of a substring.
PIECE = 16


@dataclass(frozen=True)
class MultiIndex:
    """``bits`` in a code (a multiple of 16), vectors of the fitting sample, and sizes of the search."""

    bits: int = 256
    sample_rows: int = 10_000
    rounds: int = 20
    shard_rows: int = 32_768
    query_rows: int = 256
    least_rerank: int = 256
    rerank_share: float = 0.03


def usable(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """``(id, vector)`` as long and array<double>; vectors that can have a cosine, ids that are not null.

    Null, zero and empty vectors and those with a null or non-finite component
    take no part.
    """
    return (
        vectors.select(
            F.col(ident).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")
        )
        .where("id is not null and vector is not null")
        .where("not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
        .where("exists(vector, x -> x <> 0)")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    # Dividing by the largest component first keeps squares in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learned_rotations(sample: np.ndarray, rule: MultiIndex) -> np.ndarray:
    """``bits`` directions: orthogonal matrices side by side, each fitted from another start."""
    random = np.random.default_rng(314159)
    dims = sample.shape[1]
    out = []
    while sum(r.shape[1] for r in out) < rule.bits:
        rotation, _ = np.linalg.qr(random.normal(size=(dims, dims)))
        for _ in range(rule.rounds if len(sample) >= dims else 0):
            codes = np.where(sample @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ codes)
            rotation = left @ right
        out.append(rotation)
    return np.concatenate(out, axis=1)[:, : rule.bits]


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of every vector's code, one uint16 each."""
    signs = _unit(vectors) @ rotations >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u2")


@lru_cache(maxsize=PIECE + 1)
def flips(weight: int) -> np.ndarray:
    """All 16-bit values with ``weight`` bits set."""
    every = np.arange(1 << PIECE, dtype=np.uint16)
    return every[np.bitwise_count(every) == weight]


class Shard:
    """Codes of some vectors and, for each substring, the rows by its value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotations: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.unit = _unit(self.vectors)
        self.codes = codes(self.vectors, rotations)
        self.words = np.ascontiguousarray(self.codes).view(np.uint64) if self.codes.shape[1] % 4 == 0 else self.codes
        self.rows, self.first = [], []
        for piece in self.codes.T:
            by = np.argsort(piece, kind="stable")
            self.rows.append(by)
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=1 << PIECE))]))

    def within(self, code: np.ndarray, words: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``wanted`` of them (or all)."""
        n, pieces = self.codes.shape
        seen = np.zeros(n, bool)
        distance = np.full(n, 1 << 20)
        for t in range(PIECE + 1):
            change = flips(t)
            for k in range(pieces):
                value = code[k] ^ change
                low, high = self.first[k][value], self.first[k][value.astype(np.int64) + 1]
                full = high > low
                low, count = low[full], (high - low)[full]
                if len(low):
                    ends = np.cumsum(count)
                    seen[self.rows[k][np.arange(ends[-1]) + np.repeat(low - (ends - count), count)]] = True
            new = np.flatnonzero(seen & (distance == 1 << 20))
            if len(new):
                distance[new] = np.bitwise_count(self.words[new] ^ words).sum(axis=1, dtype=np.int64)
            # Everything closer than this has been seen.
            safe = np.flatnonzero(distance < pieces * (t + 1))
            if len(safe) >= min(wanted, n):
                radius = np.partition(distance[safe], min(wanted, n) - 1)[min(wanted, n) - 1]
                return np.flatnonzero(distance <= radius)
        return np.arange(n)

    def nearest(self, query: int, vector: np.ndarray, code: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(code).view(np.uint64) if self.words.dtype == np.uint64 else code
        rows = self.within(code, words, wanted + 1)
        rows = rows[self.ids[rows] != query]
        score = cosine(self.vectors[rows], vector)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def cosine(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosine in double precision; vectors are scaled by their largest component to stay in range."""
    vector = vector / np.abs(vector).max()
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    dot = (rows * vector).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((vector * vector).sum()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(pc.list_flatten(column)).reshape(n, -1)


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    rule: MultiIndex | None = None,
    ident: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each row of ``queries`` by cosine, found by the index.

    Both tables have an id and an array of numbers. Returns query_id, rank
    (from 1), vec_id and score (double precision, original vectors), nearest
    first, equal scores by the smaller id. A query never finds rows with its
    own id; it finds all candidates if there are fewer than k. Vectors without
    a cosine and null ids take no part (``usable``); vectors are compared with those
    of the same length. A query id that repeats is answered once, for its
    first vector; an id that repeats in the index is found at most once.
    """
    rule = rule or MultiIndex()
    base = materialize(usable(vectors, ident, column), "vectors")
    asked = usable(queries, ident, column).groupBy("id").agg(F.min("vector").alias("vector"))
    lengths = base.groupBy(F.size("vector").alias("dims")).count().collect()  # one row per length
    schema = "query_id long, vec_id long, score double"
    out = base.limit(0).selectExpr("id query_id", "id vec_id", "0D score")
    for dims, total in sorted((r["dims"], r["count"]) for r in lengths):
        own = base.where(F.size("vector") == dims)
        share = min(1.0, rule.sample_rows / total)
        sample = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
        rows = np.array([r[0] for r in sample.select("vector").collect()]).reshape(-1, dims)
        rows = rows[np.lexsort(rows.T)]  # the same matrix in every run
        rotations = learned_rotations(_unit(rows), rule)
        out = out.unionByName(_search(own, asked.where(F.size("vector") == dims), total, rotations, k, rule, schema))
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(own, asked, total: int, rotations: np.ndarray, k: int, rule: MultiIndex, schema: str) -> DataFrame:
    shards = max(1, -(-total // rule.shard_rows))
    groups = max(1, -(-asked.count() // rule.query_rows))
    wanted = max(rule.least_rerank, int(rule.rerank_share * total / shards))
    names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            shard = Shard(np.asarray(left["id"]), _matrix(left["vector"]), rotations)
            ask = _matrix(right["vector"])
            for query, vector, code in zip(np.asarray(right["id"]).tolist(), ask, codes(ask, rotations), strict=True):
                ids, score = shard.nearest(query, vector, code, k, wanted)
                found.append((np.full(len(ids), query), ids, score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, names.types, strict=True)], schema=names)

    # A block of queries meets a shard: both sides of a meeting are of bounded size.
    index = own.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    question = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    return (
        index.groupBy("shard", "block").cogroup(question.groupBy("shard", "block")).applyInArrow(work, schema)
    )
