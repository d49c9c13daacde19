import numpy as np

from twinbill.llm.ann import MultiIndex, Shard, codes, cosine, flips, learned_rotations, nearest_neighbours

SMALL = "/root/testdata/sf0.001"


def _exact(ids, vectors, query, k):
    score = cosine(vectors, vectors[query])
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[query]][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_table_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], float)
    rule = MultiIndex(shard_rows=200, query_rows=4)
    out = nearest_neighbours(df, df.where("vec_id % 50 = 0"), 5, rule).collect()
    found = 0
    for q in np.flatnonzero(ids % 50 == 0):
        own = sorted((r for r in out if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        exact = _exact(ids, vectors, q, 5)
        found += len({i for i, _ in exact} & {r.vec_id for r in own})
        at = {int(i): k for k, i in enumerate(ids)}
        for r in own:
            assert abs(r.score - cosine(vectors[[at[r.vec_id]]], vectors[q])[0]) < 1e-15
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert found >= 0.9 * len(out)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 16))
    vectors[100:200] = vectors[100]  # a hot code
    rotations = learned_rotations(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), MultiIndex(bits=128))
    assert rotations.shape == (16, 128)
    shard = Shard(np.arange(700), vectors, rotations)
    for q in range(0, 700, 37):
        code = codes(vectors[[q]], rotations)[0]
        for wanted in (1, 20, 150, 5000):
            rows = shard.within(code, np.ascontiguousarray(code).view(np.uint64), wanted)
            distance = np.bitwise_count(shard.codes ^ code).sum(axis=1)
            radius = np.sort(distance)[min(wanted, 700) - 1]
            assert set(rows) == set(np.flatnonzero(distance <= radius))
    assert sum(len(flips(t)) for t in range(17)) == 1 << 16


def test_ties_nulls_and_few_candidates(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(50, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [0.5, 0.0]), (9, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (8, [inf, 1.0]), (None, [1.0, 0.0]), (10, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (11, []), (150, [1e300, 1e300]), (12, [1e-300, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, shard int")
    out = {}
    for r in nearest_neighbours(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert out == {50: [3, 7, 12, 150, 9], 150: [3, 7, 9, 12, 50]}
    assert nearest_neighbours(df.limit(0), df).count() == 0
    assert nearest_neighbours(df, df.limit(0)).count() == 0


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest_neighbours(df, df.where("vec_id = 150"), 5, MultiIndex(shard_rows=64)).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 3, 6, 9, 12]
