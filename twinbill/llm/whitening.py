"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers x (without the offset, which no result but x itself
would show). The fit list holds each distinct x vector once, written as a table
that every pass scans.

A Gram pass centres the rows, solves them against all triangular factors found so
far and sums Q'Q, a matrix of dims x dims for each task, cell by cell in Spark.
The driver adds a Cholesky factor of that matrix. The first one is shifted, so it
exists however badly the rows are conditioned; the next ones, of rows that are
nearly orthogonal already, are shifted only where the matrix is still singular.
When Q'Q is the identity, the product R of the factors is that of a QR
decomposition of the centred rows, and the singular vectors of R are the
components: the covariance itself is never decomposed, so small
eigenvalues keep their digits.

What the driver holds is dims x dims. A direction whose singular value is within
rounding of zero, beside the largest one, counts as one without variance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Entries that one step inside a task holds as doubles.
STEP_ENTRIES = 1 << 20
#: Entries whose 64-fold is beyond this are held at it; whole numbers up to here are exact doubles.
LARGEST = 2.0**53


@dataclass(frozen=True)
class Whitening:
    """``scale`` of the whole numbers, ``components`` to return, Gram passes at most and when Q'Q counts as identity."""

    scale: int = 64
    components: int = 16
    passes: int = 4
    tolerance: float = 1e-13


@dataclass
class Components:
    """Fit list's size, sums and dimensions; unit components (rows) by falling eigenvalue, those without variance left out."""

    n: int = 0
    dims: int = 0
    sums: list[int] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(vectors: DataFrame, ident: str, column: str, scale: int) -> DataFrame:
    """``(id, x)``: floor(scale * entry) of every vector that is not null or empty and has finite entries only.

    Ids may be null and rows may repeat; other columns are ignored.
    """
    entries = F.col("entries")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = F.transform(
        entries,
        lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long"),
    )
    return (
        vectors.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("entries"))
        .where(entries.isNotNull() & (F.size(entries) > 0) & finite)
        .select("id", bounded.alias("x"))
    )


def _steps(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size with their vectors as a matrix of longs."""
    rows = max(1, STEP_ENTRIES // dims)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, np.asarray(part.column("x").flatten()).reshape(-1, dims)


def _exact(x: np.ndarray, largest: int) -> np.ndarray:
    """``x`` in a type that holds results up to ``largest``."""
    return x if largest < 2**62 else x.astype(object)


def _top(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _fit_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for part, x in _steps(batches, dims):
            exact = _exact(x, _top(x) * len(x))
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
            n += part.num_rows
        if n:
            yield pa.record_batch([pa.array([-1, *range(dims)]), pa.array([str(v) for v in (n, *total)])], names=["place", "total"])

    found = (
        fit.select("x")
        .mapInArrow(run, "place long, total string")
        .groupBy("place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )  # one row a dimension
    by_place = {r["place"]: int(r["total"]) for r in found}
    return by_place[-1], [by_place[k] for k in range(dims)]


def _gram(fit: DataFrame, dims: int, rows_of) -> np.ndarray:
    """Sum of Z'Z over the fit list, Z = ``rows_of(x)``, summed cell by cell over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _steps(batches, dims):
            z = rows_of(x)
            total = z.T @ z + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "part"])

    cells = (
        fit.select("x")
        .mapInArrow(run, "i long, j long, part double")
        .groupBy("i", "j")
        .agg(F.sum("part").alias("total"))
        .toPandas()
    )  # dims x dims
    width = int(cells["i"].max()) + 1
    out = np.zeros((width, width))
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    out[i, j] = out[j, i] = cells["total"].to_numpy()
    return out


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q with ``Q @ factor == rows`` for an upper triangular factor, by forward substitution."""
    q = np.array(rows.T, order="C")
    for k in range(len(q)):
        if k:
            q[k] -= factor[:k, k] @ q[:k]
        q[k] /= factor[k, k]
    return q.T


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor, shifted in the first pass and where the matrix is singular to rounding."""
    dims = len(gram)
    norm = np.linalg.eigvalsh(gram)
    shift = 11 * (n * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * norm[-1]
    if not first and norm[0] > 10 * shift:
        shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(dims)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * norm[-1])


def fit_components(fit: DataFrame, rule: Whitening) -> Components:
    """Components of the distinct vectors ``x`` of a written table.

    The dimensions are the length that most of them have (the smaller one of
    equals); vectors of another length take no part. An empty table gives no
    components; neither does one without variance.
    """
    lengths = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return Components()
    dims = lengths["dims"]
    fit = fit.where(F.size("x") == dims)
    n, sums = _fit_sums(fit, dims)
    found = Components(n, dims, sums)
    mean = found.mean
    factors: list[np.ndarray] = []

    def rows_of(x: np.ndarray) -> np.ndarray:
        z = x - mean
        for factor in factors:
            z = solve_rows(z, factor)
        return z

    gram = _gram(fit, dims, rows_of)
    if np.trace(gram) == 0:
        return found
    while len(factors) < rule.passes and np.abs(gram - np.eye(dims)).max() > rule.tolerance:
        factors.append(_factor(gram, n, first=not factors))
        gram = _gram(fit, dims, rows_of)

    r = np.eye(dims)
    for factor in factors:
        r = factor @ r
    _, sigma, vectors = np.linalg.svd(r)
    values = sigma**2 / n
    # what rounding alone leaves of a direction without variance
    least = 64 * dims * np.finfo(float).eps * sigma[0]
    rank = min(int((sigma > least).sum()), int((np.linalg.eigvalsh(gram) > 0.5).sum()))
    found.trace = float(values[:rank].sum())
    keep = min(rank, rule.components)
    found.vectors, found.values = vectors[:keep], values[:keep]
    if keep:
        project = (found.vectors / np.sqrt(found.values)[:, None]).T
        whitened = _gram(fit, dims, lambda x: np.concatenate([(x - mean) @ project, np.ones((len(x), 1))], axis=1))
        mean_white = whitened[:-1, -1] / n
        cov = whitened[:-1, :-1] / n - np.outer(mean_white, mean_white)
        found.identity_error = float(np.abs(cov - np.eye(keep)).max())
    return found


def project(rows: DataFrame, found: Components, rule: Whitening) -> DataFrame:
    """One row for each row of ``(id, x)`` and component; null scores for components without variance."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    dims, n, k = found.dims, found.n, len(found.values)
    width = min(rule.components, dims)
    mean = found.mean if n else np.zeros(0)
    scaled = (found.vectors / np.sqrt(found.values)[:, None]).T if k else np.zeros((dims, 0))
    explained = [float(v / found.trace) for v in found.values] + [0.0 if found.trace else None] * (width - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = max((abs(s) for s in found.sums), default=0)
        for part, x in _steps(batches, dims):
            m = len(x)
            exact = _exact(x, n * _top(x) + spread)
            apart = exact * n - np.array(found.sums, dtype=exact.dtype)
            apart = _exact(apart, dims * _top(apart) ** 2)
            total = (apart * apart).sum(axis=1)
            deviation = pa.array([int(v) if v < 2**63 else None for v in total], pa.int64())
            white = np.full((m, width), np.nan)
            white[:, :k] = (x - mean) @ scaled
            at = np.repeat(np.arange(m), width)
            flat = white.ravel()
            yield pa.record_batch(
                [
                    part.column("id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                    pa.array(np.full(len(at), n, np.int64)),
                    deviation.take(pa.array(at)),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([found.identity_error] * len(at), pa.float64()),
                ],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.where(F.size("x") == dims).mapInArrow(run, schema)


def whiten(
    vectors: DataFrame, rule: Whitening | None = None, ident: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Scores of every usable vector on the whitened components of the distinct ones.

    Null and empty vectors, those with a null or non-finite entry, and those
    whose length is not the most common one have no rows. A deviation beyond a
    long is null. Components without variance have null scores and explain 0
    (null where nothing varies). Null ids stay null, repeated rows each
    get their rows, other columns are ignored, an empty table gives none.
    """
    rule = rule or Whitening()
    rows = whole_vectors(vectors, ident, column, rule.scale)
    fit = materialize(rows.select("x").distinct(), "fit-list")
    return project(rows, fit_components(fit, rule), rule)
