"""Moments and judges: one pass instead of several, the same figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_model import MODEL
from twinbill.operators import logistic as LG
from twinbill.operators import metrics as X
from twinbill.operators.features import exact_baseline, pair_features
from twinbill.operators.scoring import score
from twinbill.schema import FEATURE_NAMES
from twinbill.session import materialize


@pytest.fixture(scope="module")
def pairs(ledger):
    return materialize(pair_features(ledger), "features")


def test_moments_give_scaler_weights_and_first_step(pairs):
    seen = LG.moments(pairs.repartition(3))
    mean, scale = LG.scaler(pairs)
    assert np.allclose(seen.scaler(), (mean, scale), rtol=1e-12, atol=1e-13)
    assert seen.weights() == pytest.approx(LG.class_weights(pairs), rel=1e-14)
    assert seen.scaler()[1][FEATURE_NAMES.index("currency_same")] == 1.0
    zero = np.zeros(len(FEATURE_NAMES) + 1)
    for a, b in zip(
        seen.first_objective(*seen.scaler(), seen.weights()),
        LG._objective(pairs, zero, mean, scale, seen.weights()),
        strict=True,
    ):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-7)


def test_blocks_give_the_sums_of_the_rows(pairs):
    blocks = LG.in_blocks(pairs.repartition(3))
    assert blocks.columns == [LG.BLOCK] and 3 <= blocks.count() < pairs.count() / 100
    for a, b in zip(vars(LG.moments(blocks)).values(), vars(LG.moments(pairs)).values(), strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-12)
    point = np.linspace(-1, 1, len(FEATURE_NAMES) + 1)
    mean, scale = LG.scaler(pairs)
    for a, b in zip(*[LG._objective(df, point, mean, scale, (0.6, 3.0)) for df in (blocks, pairs)], strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-7)
    assert LG.in_blocks(pairs.limit(0)).isEmpty()


def test_every_pass_of_newton_reads_the_blocks(pairs, monkeypatch):
    read = []
    sums = LG.objective_parts
    monkeypatch.setattr(LG, "objective_parts", lambda train, *rest: read.append(train.columns) or sums(train, *rest))
    LG.fit(pairs)
    assert read and all(columns == ["block"] for columns in read)


def test_moments_of_one_class_are_refused(pairs):
    with pytest.raises(ValueError, match="both classes"):
        LG.fit(pairs.filter("label = 0"))
    with pytest.raises(ValueError, match="both classes"):
        LG.fit(pairs.limit(0))


def test_judges_equal_single_evaluations(pairs):
    scored = score(pairs, MODEL).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    rule = exact_baseline()
    judges = {"model": (F.col("probability"), F.col("prediction")), "baseline": (rule, rule)}
    found = {r["judge"]: r.asDict() for r in X.evaluate_judges(scored, judges, 50.0).collect()}
    assert set(found) == set(judges)
    for name, (p, call) in judges.items():
        one = scored.withColumns({"probability": p.cast("double"), "prediction": call})
        expected = X.evaluate(one).first().asDict() | X.operational_metrics(one, 50.0).first().asDict()
        for key, value in expected.items():
            assert found[name][key] == pytest.approx(value, rel=1e-12), (name, key)


def test_only_unequal_buckets_are_joined(spark):
    from twinbill.operators.compare import differences, suspects, unequal_rows

    rows = [(k, None if k % 7 == 0 else f"t{k}", k / 3, k % 5) for k in range(2000)]
    schema = "id long, text string, x double, n int"
    a = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame(rows[::-1], schema).repartition(5)
    assert [df.count() for df in suspects(a, same, ["id"])] == [0, 0]
    assert differences(a, same, ["id"]).isEmpty() and unequal_rows(a, same).isEmpty()
    changed = [r for r in rows if r[0] != 40]
    changed[3] = (3, "other", 1.0, 3)
    changed[9] = (9, "t9", 3.0 * (1 + 1e-13), 4)  # within tolerance
    b = spark.createDataFrame([*changed, (5000, "new", 0.0, 0), changed[1]], schema)
    looked_at = [df.count() for df in suspects(a, b, ["id"])]
    assert all(3 <= n <= 60 for n in looked_at)
    found = {(r["id"], r["column"]) for r in differences(a, b, ["id"]).collect()}
    assert found == {(3, "text"), (40, "text"), (40, "x"), (40, "n"), (5000, "text"), (5000, "x"), (5000, "n")}
    sides = sorted((r["side"], r["id"]) for r in unequal_rows(a, b).collect())
    assert sides == [("candidate", 1), ("candidate", 3), ("candidate", 9), ("candidate", 5000), ("reference", 3), ("reference", 9), ("reference", 40)]


def test_unequal_rows_meet_in_one_aggregate(spark):
    """Copies count, NULL equals NULL, and the tables are computed once, however often they are read."""
    from twinbill.operators.compare import unequal_rows

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    schema = "id long, text string"
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], schema).mapInArrow(seen, schema)
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (3, "y")], schema)
    found = sorted((r["id"], r["text"], r["side"]) for r in unequal_rows(a, b).collect())
    assert found == [
        (1, "x", "reference"), (1, "x", "reference"), (3, "y", "candidate"), (3, "y", "candidate"), (3, "z", "reference"),
    ]
    assert calls.value == 5
