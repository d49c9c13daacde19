import math
import random
from datetime import date, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.conftest import INVOICE, invoice
from twinbill.operators import blocking as B
from twinbill.operators.features import exact_baseline, exact_key_pairs, pair_features
from twinbill.params import TriageParams
from twinbill.schema import FEATURE_NAMES

PARAMS = TriageParams()


def ids(pairs):
    return sorted((r["left_invoice_id"], r["right_invoice_id"]) for r in pairs.collect())


def random_rows(count, seed=1, days=200):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        rows.append(
            invoice(
                f"I{i:04d}",
                f"G{rng.randrange(count)}",
                rng.choice(["INV-", "DOC-", "inv"]) + str(rng.randrange(10**4)),
                date(2024, 1, 1) + timedelta(days=rng.randrange(days)),
                rng.choice([100.0, 103.0, 105.0, 110.0, 1000.0, 0.004, 0.005]),
                rng.choice(["V1", "V2", "V3"]),
                rng.choice(["TRY", "EUR"]),
                rng.choice(["", "P1", "P2"]),
                # a third and more of all rows share the empty token
                rng.choice(["", "", "B1", "B2"]),
                rng.choice(["", "small ring", "red bolt"]),
            )
        )
    return rows


def brute_force(rows, params=PARAMS):
    """Pairs by definition, row by row."""

    def norm(text):
        return "".join(c for c in text.upper() if c.isalnum())

    found = {}
    ordered = sorted(rows, key=lambda r: (r[4], r[0]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if a[6] != b[6] or (a[2] != b[2] and a[8] != b[8]):
                continue
            if (b[4] - a[4]).days > params.max_date_gap_days:
                continue
            gap = abs(a[5] - b[5]) / max(a[5], b[5], 0.01)
            number = SequenceMatcher(None, norm(a[3]), norm(b[3])).ratio()
            if gap > params.max_amount_relative_gap and number < params.min_invoice_similarity:
                continue
            text = SequenceMatcher(None, norm(a[9]), norm(b[9])).ratio()
            found[a[0], b[0]] = {
                "vendor_same": float(a[2] == b[2]),
                "bank_same": float(a[8] == b[8]),
                "currency_same": 1.0,
                "invoice_similarity": number,
                "amount_relative_similarity": max(0.0, 1 - gap),
                "date_proximity": math.exp(-(b[4] - a[4]).days / 30),
                "po_same": float(a[7] != "" and a[7] == b[7]),
                "description_similarity": text,
                "label": int(a[1] == b[1]),
            }
    return found


@pytest.fixture(scope="module")
def rows():
    return random_rows(150)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, INVOICE)


def test_labelled_pair_is_kept(small):
    pairs = B.candidate_pairs(small, PARAMS)
    assert ids(pairs) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert sum(r["label"] for r in pairs.collect()) == 1
    recall = B.candidate_recall(small, pair_features(small)).first()
    assert (recall["candidate_recall"], recall["group_recall"]) == (1.0, 1.0)


def test_candidates_equal_brute_force(table, rows):
    assert ids(B.candidate_pairs(table, PARAMS)) == sorted(brute_force(rows))


@pytest.mark.parametrize("days, gap, floor", [(1, 0.0, 0.9), (7, 0.5, 0.2), (365, 0.05, 1.0)])
def test_other_parameters_equal_brute_force(table, rows, days, gap, floor):
    params = TriageParams(days, gap, floor)
    assert ids(B.candidate_pairs(table, params)) == sorted(brute_force(rows, params))


def test_features_equal_brute_force(table, rows):
    expected = brute_force(rows)
    for row in pair_features(table).collect():
        want = expected.pop((row["left_invoice_id"], row["right_invoice_id"]))
        for name, value in want.items():
            assert row[name] == pytest.approx(value, abs=1e-12), name
        assert 0 <= row["digit_similarity"] <= 1
    assert not expected


def test_feature_order_and_bounds(small):
    features = pair_features(small)
    assert [c for c in features.columns if c in FEATURE_NAMES] == list(FEATURE_NAMES)
    for row in features.collect():
        assert all(0 <= row[name] <= 1 for name in FEATURE_NAMES)
    assert features.agg(F.sum(exact_baseline())).first()[0] == 1
    assert ids(exact_key_pairs(small)) == [("A", "B")]


@pytest.mark.parametrize("cell_rows", [None, 1, 3, 20])
def test_cutting_large_cells_changes_nothing(table, cell_rows):
    prepared = B.prepare(table)
    whole = ids(B.band_pairs(prepared, max_days=60, cell_rows=None))
    assert len(set(whole)) == len(whole)
    assert ids(B.band_pairs(prepared, max_days=60, cell_rows=cell_rows)) == whole


def test_large_cells_beyond_the_broadcast_bound(spark, table):
    prepared = B.prepare(table)
    whole = ids(B.band_pairs(prepared, max_days=60, cell_rows=None))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert ids(B.band_pairs(prepared, max_days=60, cell_rows=2)) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_of_a_census_serve_as_the_crowded_ones(table):
    from twinbill.operators.validate import take_census

    census = take_census(table, labels=True, blocks=B.BLOCKS, rows=3)
    counted = B.crowded_blocks(B.blocked(table, tuple(B.BLOCKS)), 3)
    assert sorted(census.crowded.collect()) == sorted(counted.collect()) != []
    prepared = B.prepare(table)
    whole = ids(B.band_pairs(prepared, max_days=60, cell_rows=None))
    assert ids(B.band_pairs(prepared, max_days=60, cell_rows=3, crowded=census.crowded)) == whole


@pytest.mark.parametrize("gap", [0.0, 0.02, 0.05, 0.5, 0.9])
def test_amount_band_equals_filter(table, gap):
    prepared = B.prepare(table)
    close = B.amount_gap(F.col("left_amount"), F.col("right_amount")) <= gap
    plain = ids(B.band_pairs(prepared, max_days=60).filter(close))
    assert ids(B.band_pairs(prepared, max_days=60, max_gap=gap, cell_rows=5)) == plain


def test_partitioning_and_row_order_do_not_matter(table):
    expected = ids(B.candidate_pairs(table))
    shuffled = table.repartition(7, "amount").orderBy(F.desc("invoice_id"))
    assert ids(B.candidate_pairs(shuffled)) == expected


def test_table_order_can_set_the_sides(spark):
    df = spark.createDataFrame(
        [
            invoice("late", number="DIET", day=date(2026, 1, 9)),
            invoice("early", number="TIDE", day=date(2026, 1, 2)),
        ],
        INVOICE,
    ).withColumn("row", F.when(F.col("invoice_id") == "late", 0).otherwise(1))
    by_date = pair_features(df).first()
    by_row = pair_features(df, order="row").first()
    assert (by_date["left_invoice_id"], by_date["invoice_similarity"]) == ("early", 0.25)
    assert (by_row["left_invoice_id"], by_row["invoice_similarity"]) == ("late", 0.5)


def test_no_pairs_gives_a_typed_empty_table(spark):
    df = spark.createDataFrame([invoice("A"), invoice("B", vendor="X", bank="Y")], INVOICE)
    features = pair_features(df)
    assert features.count() == 0 and set(FEATURE_NAMES) < set(features.columns)
    assert B.candidate_recall(df, features).first()["candidate_recall"] == 0.0


def test_recall_without_duplicates_is_one(spark):
    df = spark.createDataFrame([invoice("A", "G1"), invoice("B", "G2")], INVOICE)
    assert B.candidate_recall(df, pair_features(df)).first()["candidate_recall"] == 1.0


def test_lookup_attaches_both_sides(small):
    pairs = B.candidate_pairs(small).select("left_invoice_id", "right_invoice_id")
    found = B.lookup_sides(pairs, small.select("invoice_id", "po_number"))
    rows = {(r["left_invoice_id"], r["right_invoice_id"]): r for r in found.collect()}
    assert rows["A", "C"]["left_po_number"] == "PO-1"
    assert rows["A", "C"]["right_po_number"] == "PO-2"


def test_large_keys_stay_apart(spark):
    """Suppliers and parts beyond 31 bits keep their numbers; the smallest line wins."""
    from twinbill.sources.ledger import order_suppliers

    lines = spark.createDataFrame(
        [(1, 2, 5, 5), (1, 1, 200_000_001, 3_000_000_000), (2, 7, 1 << 40, (1 << 50) + 1)],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long",
    )
    got = {r["o_orderkey"]: (r["sk"], r["p_partkey"]) for r in order_suppliers(lines).collect()}
    assert got == {1: (200_000_001, 3_000_000_000), 2: (1 << 40, (1 << 50) + 1)}


def test_exact_keys_do_not_depend_on_the_amount_gap(spark):
    from tests.conftest import INVOICE, invoice
    from twinbill.operators.features import exact_key_pairs
    from twinbill.params import TriageParams

    df = spark.createDataFrame(
        [invoice("A", "G1", amount=1_000_000.0), invoice("B", "G1", amount=1_000_000.5)], INVOICE
    )
    for gap in (0.0, 1e-7, 0.05):
        assert exact_key_pairs(df, TriageParams(max_amount_relative_gap=gap)).count() == 1


def test_prepared_rows_are_normalised_once(ledger, monkeypatch):
    """The count of the blocks and both sides of the join read written rows; marks stay free of NULL tests."""
    made, write = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, label, by=(): made.append(label) or write(df, label, by))
    pairs = B.sided_pairs(ledger, PARAMS)
    assert made.count("prepared") == 1
    rows = B.written(B.prepare(ledger.limit(5)))
    assert not any(f.nullable for c in ("number_marks", "description_marks") for f in rows.schema[c].dataType)
    # no side of the join normalises a text or counts its characters again
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "_marks_udf" not in plan and "regexp_replace" not in plan
    assert pairs.count() > 0


def test_cells_hold_every_pair_once(spark):
    """One invoice a day over several cells: pairs across every border, and none twice."""
    days = [date.fromordinal(date(2023, 12, 1).toordinal() + k) for k in range(4 * B.CELL_BANDS * 5)]
    rows = [invoice(f"I{k:03d}", day=day) for k, day in enumerate(days)]
    table = spark.createDataFrame(rows, INVOICE)
    copies = B.day_cells(table, 5)
    assert copies.filter("not copied").count() == len(days)
    assert copies.count() <= len(days) * (1 + 1 / B.CELL_BANDS) + 5
    wanted = sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 : i + 6])
    assert ids(B.band_pairs(B.prepare(table), max_days=5, blocks=("vendor",))) == wanted


def test_both_sides_of_the_join_read_one_exchange(spark, table):
    from tests.test_model import MODEL
    from twinbill.plans.triage import flagged_pairs

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        labelled = table.withColumns({"is_duplicate_record": F.lit(True), "duplicate_type": F.lit("exact")})
        for pairs in (pair_features(labelled), B.candidate_pairs(table), flagged_pairs(table, MODEL, prune=False)):
            pairs.collect()
            assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("left", [True, False, None])
@pytest.mark.parametrize("right", [True, False, None])
def test_type_of_a_pair(spark, left, right):
    from twinbill.operators.features import pair_type

    schema = "left_is_duplicate_record boolean, left_duplicate_type string, right_is_duplicate_record boolean, right_duplicate_type string"
    for kinds in (("a", "b"), (None, "b"), ("a", None)):
        row = spark.createDataFrame([(left, kinds[0], right, kinds[1])], schema).select(pair_type()).first()
        assert row[0] == (kinds[1] if right else kinds[0])
