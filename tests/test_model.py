import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_pairs import random_rows
from tests.conftest import INVOICE
from twinbill.operators import logistic as LG
from twinbill.operators import metrics as X
from twinbill.operators import scoring as SC
from twinbill.operators.features import pair_features
from twinbill.params import TriageParams
from twinbill.plans.triage import flagged_pairs, triage
from twinbill.schema import FEATURE_NAMES
from twinbill.sources.model_store import load_model, save_model

MODEL = SC.Model(
    mean=(0.5, 0.9, 1.0, 0.7, 0.6, 0.5, 0.4, 0.1, 0.3),
    scale=(0.5, 0.3, 1.0, 0.2, 0.2, 0.3, 0.25, 0.3, 0.3),
    coefficient=(0.5, 0.3, 0.0, 1.0, 1.0, 2.0, 1.0, 0.5, 1.0),
    intercept=-3.0,
    threshold=0.8,
)


def scored(spark, labels, probabilities, predictions=None):
    predictions = predictions or [0] * len(labels)
    rows = list(zip(labels, probabilities, predictions))
    return spark.createDataFrame(rows, "label int, probability double, prediction int")


def test_grid_is_that_of_a_linear_space():
    assert LG.threshold_grid() == list(np.linspace(0.05, 0.95, 181))
    assert LG.threshold_grid()[171] == 0.9049999999999999


def test_threshold_respects_the_precision_floor(spark):
    table = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])
    assert LG.select_threshold(table, 1.0).first()[0] == LG.threshold_grid()[110]
    chosen = LG.freeze_threshold(MODEL, table, TriageParams(min_validation_precision=1.0))
    assert [p >= chosen.threshold for p in (0.1, 0.4, 0.6, 0.9)] == [False, False, True, True]


def test_threshold_sweep_equals_brute_force(spark):
    rng = random.Random(3)
    grid = LG.threshold_grid()
    p = [rng.choice([rng.random(), rng.choice(grid)]) for _ in range(400)]
    y = [int(rng.random() < v) for v in p]
    best = []
    for row in LG.threshold_table(scored(spark, y, p)).collect():
        t = row["threshold"]
        tp = sum(a for a, b in zip(y, p) if b >= t)
        fp = sum(1 - a for a, b in zip(y, p) if b >= t)
        assert (row["tp"], row["fp"], row["fn"]) == (tp, fp, sum(y) - tp)
        precision = tp / (tp + fp) if tp + fp else 0.0
        if precision >= 0.6:
            best.append((2 * tp / (tp + fp + sum(y)), precision, t))
    assert LG.select_threshold(scored(spark, y, p), 0.6).first()[0] == max(best)[2]


def test_unreachable_floor_is_an_error(spark):
    with pytest.raises(ValueError, match="precision floor"):
        LG.freeze_threshold(MODEL, scored(spark, [0, 0], [0.9, 0.9]), TriageParams())


def test_evaluation_of_a_perfect_ranking(spark):
    row = X.evaluate(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 0, 2)
    assert row["f1"] == row["average_precision"] == row["roc_auc"] == 1.0


@pytest.fixture(params=[1, 4, 40])
def range_count(spark, request):
    """Range partitions of exactly that number."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, (request.param, "false"), strict=True):
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def test_places_and_running_totals(spark, range_count):
    from twinbill.operators.ranges import in_order, laid_out, running_totals, with_place

    rng = random.Random(8)
    rows = [(k, rng.randint(0, 30), rng.choice([1, 5, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, score int, n long").repartition(7)
    order = (F.desc("score"), F.col("id").asc())
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    placed = with_place(in_order(df, *order)).collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["place"])] == [r[0] for r in expected]
    assert sorted(r["place"] for r in placed) == list(range(1, 301))
    total, sums = 0, {}
    for i, _, n in expected:
        total += n or 0
        sums[i] = total
    assert {r["id"]: r["t"] for r in running_totals(in_order(df, *order), t="n").collect()} == sums
    lying = with_place(laid_out(df.orderBy(*order))).collect()
    assert [r["id"] for r in sorted(lying, key=lambda r: r["place"])] == [r[0] for r in expected]
    assert with_place(in_order(df.limit(0), *order)).isEmpty()


def test_ranking_equals_brute_force(spark, range_count):
    """With one score range and with many, ties included."""
    rng = random.Random(4)
    p = [round(rng.random(), 2) for _ in range(500)]
    y = [int(rng.random() < v) for v in p]
    pos = [b for a, b in zip(y, p) if a]
    neg = [b for a, b in zip(y, p) if not a]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    precision = 0.0
    for t in sorted(set(p), reverse=True):
        hit = sum(a == t for a in pos)
        above = sum(b >= t for b in p)
        precision += hit / len(pos) * sum(a >= t for a in pos) / above
    row = X.ranking_metrics(scored(spark, y, p)).first()
    assert row["roc_auc"] == pytest.approx(area, abs=1e-12)
    assert row["average_precision"] == pytest.approx(precision, abs=1e-12)


def test_operational_metrics(spark):
    rows = [(1, 1, 100.0), (1, 0, 50.0), (0, 1, 7.0), (0, 0, 9.0)]
    df = spark.createDataFrame(rows, "label int, prediction int, exposure double")
    row = X.operational_metrics(df, 50.0).first()
    assert row["review_rate"] == 0.5
    assert row["duplicate_value_capture"] == pytest.approx(100 / 150)
    assert row["expected_control_cost"] == 100.0
    none = X.operational_metrics(df.filter("label = 0"), 50.0).first()
    assert (none["duplicate_value_capture"], none["expected_control_cost"]) == (1.0, 50.0)


def newton(x, y):
    """Dense solution of the same objective."""
    scale = x.std(axis=0)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(scale == 0, 1, scale), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ b)))
        gradient = z.T @ (w * (p - y)) + b
        hessian = z.T @ (z * (w * p * (1 - p))[:, None]) + np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return b


@pytest.fixture(scope="module")
def training(spark, ledger):
    from twinbill.session import materialize

    return materialize(pair_features(ledger), "features")


def test_fit_equals_a_dense_solution(training):
    pdf = training.select(*FEATURE_NAMES, "label").toPandas()
    expected = newton(pdf[list(FEATURE_NAMES)].to_numpy(), pdf["label"].to_numpy())
    model = LG.fit(training)
    assert [*model.coefficient, model.intercept] == pytest.approx(list(expected), abs=1e-7)
    assert model.coefficient[2] == 0 and model.scale[2] == 1  # constant feature
    again = LG.fit(training.repartition(5))
    assert again.coefficient == pytest.approx(model.coefficient, rel=1e-7, abs=1e-9)


def test_mllib_solver_separates_the_classes(training):
    model = replace(LG.fit(training, solver="mllib"), threshold=0.5)
    table = SC.score(training, model).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int")
    )
    assert X.evaluate(table).first()["roc_auc"] > 0.99


def test_one_class_is_refused(training):
    with pytest.raises(ValueError, match="both classes"):
        LG.fit(training.filter("label = 1"))


def test_model_round_trip_and_tampering(spark, tmp_path):
    path = str(tmp_path / "model")
    digest = save_model(spark, MODEL, path)
    assert load_model(spark, path) == MODEL and len(digest) == 64
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("threshold", F.lit(0.1))
    manifest.write.parquet(f"{path}-changed/manifest")
    spark.read.parquet(f"{path}/parameters").write.parquet(f"{path}-changed/parameters")
    with pytest.raises(ValueError, match="integrity"):
        load_model(spark, f"{path}-changed")


def test_evidence_is_ranked(spark, small):
    row = pair_features(small).select("*", SC.evidence(MODEL).alias("e")).first()
    assert len(row["e"]) == 4
    sizes = [abs(item["contribution"]) for item in row["e"]]
    assert sizes == sorted(sizes, reverse=True)
    for item in row["e"]:
        i = FEATURE_NAMES.index(item["feature"])
        value = row[item["feature"]]
        exact = (value - MODEL.mean[i]) / MODEL.scale[i] * MODEL.coefficient[i]
        assert item["contribution"] == pytest.approx(exact, abs=1e-6)


def test_policy(spark):
    def state(probability, number):
        row = spark.range(1).select(
            F.lit(1.0).alias("vendor_same"),
            F.lit(number).alias("invoice_similarity"),
            F.lit(1.0).alias("amount_relative_similarity"),
        )
        return row.select(SC.decide(F.lit(probability), 0.5).alias("d")).first()["d"]["state"]

    assert (state(0.9, 1.0), state(0.8, 0.8)) == ("HOLD", "REVIEW")
    assert (state(0.2, 0.8), state(0.2, 1.0)) == ("PASS", "PASS")


def test_triage_masks_vendors_and_ranks(small):
    rows = triage(small, replace(MODEL, threshold=0.05), pepper="test").collect()
    assert rows and rows[0]["state"] == "HOLD" and rows[0]["vendor_ref"].startswith("ref_")
    assert "SUP-1" not in str(rows)
    scores = [r["risk_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


STRICT = replace(MODEL, intercept=-12.0)  # only close pairs can reach it
ONE_BLOCK = replace(MODEL, coefficient=(4.0, 0.3, 0.0, 1.0, 1.0, 2.0, 1.0, 0.5, 1.0), intercept=-14.0)
SIGNED = replace(MODEL, coefficient=(0.5, -0.3, 0.0, -1.0, 1.0, 2.0, 1.0, -0.5, 1.0))


@pytest.mark.parametrize("model", [MODEL, STRICT, ONE_BLOCK, SIGNED])
def test_pruned_triage_flags_the_same_pairs(spark, ledger, model):
    extra = spark.createDataFrame(random_rows(150, seed=9), INVOICE)
    for table in (extra, ledger):
        pruned = flagged_pairs(table, model).orderBy("left_invoice_id", "right_invoice_id")
        plain = flagged_pairs(table, model, prune=False)
        assert pruned.collect() == plain.orderBy("left_invoice_id", "right_invoice_id").collect()


def test_reach_narrows_the_join():
    params = TriageParams()
    assert SC.reach(MODEL, params) == SC.Reach(60, None, ("vendor", "bank"))
    limits = SC.reach(STRICT, params)
    assert limits.max_gap is not None and limits.max_gap < 1 and limits.max_days < 60
    assert SC.reach(ONE_BLOCK, params).blocks == ("vendor",)


def test_probability_is_the_logistic_of_the_margin(spark, small):
    row = SC.score(pair_features(small), MODEL).first()
    margin = MODEL.intercept + sum(
        (row[n] - m) / s * c for n, m, s, c in MODEL.terms()
    )
    assert row["probability"] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-12)




def test_unconverged_fit_is_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F

    from twinbill.operators import logistic
    from twinbill.schema import FEATURE_NAMES

    rows = spark.range(200).select(
        *[(F.rand(k) + F.col("id") % 2).alias(name) for k, name in enumerate(FEATURE_NAMES)],
        (F.col("id") % 2).cast("int").alias("label"),
    )
    logistic.fit(rows)
    monkeypatch.setattr(logistic, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError, match="settle"):
        logistic.fit(rows)


def test_edited_manifest_flag_is_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    from twinbill.sources.model_store import load_model, save_model

    save_model(spark, MODEL, str(tmp_path / "m"))
    manifest = spark.read.parquet(str(tmp_path / "m" / "manifest"))
    changed = manifest.withColumn("synthetic_training_data", ~F.col("synthetic_training_data"))
    rows = changed.collect()
    spark.createDataFrame(rows, manifest.schema).write.mode("overwrite").parquet(str(tmp_path / "m" / "manifest"))
    with pytest.raises(ValueError, match="integrity"):
        load_model(spark, str(tmp_path / "m"))


def test_ranking_of_scores_across_batches(spark, range_count):
    """Ties that go over several Arrow batches and tasks, unknown scores and labels, and two judges."""
    rng = random.Random(9)
    rows = [
        (rng.choice(["a", "b"]), rng.choice([0, 1, 1, None]), rng.choice([0.25, 0.25, 0.5, None, float("nan"), rng.random()]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "judge string, label int, probability double").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        found = {r["judge"]: r for r in X.ranking_metrics(df, "judge").collect()}
        alone = {j: X.ranking_metrics(df.filter(F.col("judge") == j)).first() for j in "ab"}
    finally:
        spark.conf.set(name, before)
    for judge in "ab":
        height = {None: -1.0}
        scores = [
            (2.0 if p is not None and p != p else height.get(p, p), y) for j, y, p in rows if j == judge and y is not None
        ]
        positive, negative = ([p for p, y in scores if y == wanted] for wanted in (1, 0))
        area = sum((p > q) + (p == q) / 2 for p in positive for q in negative) / (len(positive) * len(negative))
        precision = sum(sum(q >= p for q in positive) / sum(q >= p for q, _ in scores) for p in positive) / len(positive)
        for row in (found[judge], alone[judge]):
            assert row["roc_auc"] == pytest.approx(area, abs=1e-12)
            assert row["average_precision"] == pytest.approx(precision, abs=1e-12)
    assert X.ranking_metrics(df.limit(0)).first().asDict() == {"average_precision": 0.0, "roc_auc": None}
