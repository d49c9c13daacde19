import numpy as np
import pytest

from twinbill.llm.queries import op13_embedding_whitening
from twinbill.llm.whitening import Whitening, solve_rows, whiten

SMALL = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """vec_id, deviation, whitened and explained by an eigendecomposition of the covariance in memory."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    white = (x - sums / n) @ vectors[:, :components] / np.sqrt(values[:components])
    return n, deviation, white, values[:components] / values.sum()


def test_equals_an_eigendecomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    n, deviation, white, explained = brute(rows)
    out = op13_embedding_whitening(spark, SMALL).toPandas()
    assert len(out) == len(rows) * 16
    out = out.sort_values(["vec_id", "component"])
    order = np.argsort([i for i, _ in rows])
    assert (out["n"] == n).all()
    assert out["deviation"].tolist() == np.repeat(np.array(deviation)[order], 16).tolist()
    got = out["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((got * white[order]).sum(axis=0))
    assert np.abs(got * signs - white[order]).max() < 1e-9
    assert np.abs(out["explained"].to_numpy()[:16] / explained - 1).max() < 1e-10
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-10


def test_repeats_count_once_and_bad_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.normal(size=3)], 1) for k in range(40)]
    bad = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [1.0, float("nan"), 2.0], 1), (93, [float("inf"), 0.0, 0.0], 1),
           (94, [], 1), (95, [1.0, 2.0], 1)]
    again = [(50 + k, good[0][1], 1) for k in range(30)] + [(None, good[1][1], 1)]
    df = spark.createDataFrame(good + bad + again, "vec_id long, embedding array<double>, n int")
    out = whiten(df).toPandas()
    _, deviation, white, _ = brute([(i, v) for i, v, _ in good], 3)
    assert (out["n"] == 40).all() and set(out["component"]) == {1, 2, 3}
    assert len(out) == 3 * 71 and out["vec_id"].isna().sum() == 3
    assert not set(out["vec_id"].dropna()) & {i for i, *_ in bad}
    first = out[out["vec_id"] == 77].sort_values("component")
    assert np.allclose(np.abs(first["whitened"]), np.abs(white[0])) and (first["deviation"] == deviation[0]).all()


def test_badly_conditioned_and_singular(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2000, 2000, size=(300, 3)).astype(float)
    # the fourth dimension nearly repeats the first, the fifth repeats the second
    near = base[:, :1] * 1000 + rng.integers(0, 2, size=(300, 1))
    x = np.concatenate([base[:, :1] * 1000, base[:, 1:], near, base[:, 1:2]], axis=1) / 64
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert out[out["component"] == 5]["whitened"].isna().all() and (out[out["component"] == 5]["explained"] == 0).all()
    fourth = out[out["component"] == 4]["whitened"].to_numpy()
    assert abs(fourth.var() - 1) < 1e-8 and out["identity_error"].iloc[0] < 1e-8
    assert out[out["component"] == 4]["explained"].iloc[0] < 1e-12


def test_huge_entries_nothing_varying_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    huge = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], schema)).toPandas()
    assert len(huge) == 6 and huge["deviation"].isna().any()
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    assert whiten(spark.createDataFrame([], schema)).count() == 0


def test_column_limit_and_triangular_solve(spark):
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5)
    rows = rng.normal(size=(7, 5))
    assert np.allclose(solve_rows(rows, r) @ r, rows)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    assert whiten(df, Whitening(components=2)).count() == 14


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_changes_nothing(spark, partitions):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    a = whiten(df).toPandas().sort_values(["vec_id", "component"])["whitened"].to_numpy()
    b = whiten(df.repartition(partitions)).toPandas().sort_values(["vec_id", "component"])["whitened"].to_numpy()
    assert np.abs(np.abs(a) - np.abs(b)).max() < 1e-9
