import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import INVOICE, invoice
from twinbill.operators import validate as V
from twinbill.params import TriageParams
from twinbill.schema import INVOICE_COLUMNS
from twinbill.sources.files import read_csv, read_json_batches


def as_text(df):
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def test_parameters_are_range_checked():
    with pytest.raises(ValueError, match="max_date_gap_days"):
        TriageParams(max_date_gap_days=0)
    with pytest.raises(ValueError, match="min_validation_precision"):
        TriageParams(min_validation_precision=1.5)
    for wrong in (
        {"max_amount_relative_gap": -1.0},
        {"min_invoice_similarity": 7.0},
        {"false_positive_review_cost": -5.0},
    ):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            TriageParams(**wrong)


def test_valid_table_passes(small):
    V.validate(small, labels=True)


def test_missing_columns_are_listed(small):
    with pytest.raises(ValueError, match=r"missing required columns: \['amount', 'currency'\]"):
        V.validate(small.drop("amount", "currency"))
    with pytest.raises(ValueError, match="group_id"):
        V.validate(small.drop("group_id"), labels=True)
    V.validate(small.drop("group_id"))


def test_rules_are_reported_in_order(small):
    text = as_text(small)
    with pytest.raises(ValueError, match="empty"):
        V.validate(text.limit(0))
    no_date = text.withColumn("invoice_date", F.lit("2026-02-30"))
    with pytest.raises(ValueError, match="ISO dates"):
        V.validate(no_date)
    null = no_date.withColumn("currency", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="null"):
        V.validate(null)
    for amount in ("0", "-1", "abc", "NaN"):
        with pytest.raises(ValueError, match="positive"):
            V.validate(null.withColumn("amount", F.lit(amount)))
    with pytest.raises(ValueError, match="unique"):
        V.validate(null.withColumn("amount", F.lit("0")).union(null))


def test_unknown_columns_are_refused_on_request(small):
    V.forbid_unknown_columns(small.drop("group_id"))
    with pytest.raises(ValueError, match="group_id"):
        V.forbid_unknown_columns(small)


CASES = [
    ({}, []),
    ({"invoice_id": "  "}, ["invoice_id_length"]),
    ({"vendor_account_id": "v" * 81}, ["vendor_account_id_length"]),
    ({"vendor_account_id": " " + "v" * 80 + "\t"}, []),
    ({"bank_fingerprint": "a\x01b"}, ["bank_fingerprint_control_character"]),
    ({"invoice_number": "a\x01b"}, []),
    ({"amount": "0"}, ["amount_not_positive"]),
    ({"amount": "1000000000"}, []),
    ({"amount": "1000000000.01"}, ["amount_too_large"]),
    ({"amount": "1.005"}, ["amount_decimals"]),
    ({"amount": "1.500"}, []),
    ({"amount": "ten"}, ["amount_not_a_number"]),
    ({"currency": "TRY\n"}, ["currency_form"]),
    ({"currency": "try"}, ["currency_form"]),
    ({"po_number": "p" * 81}, ["po_number_length"]),
    ({"po_number": None}, []),
    ({"description": "d" * 501}, ["description_length"]),
    ({"invoice_date": "2026-13-01"}, ["invoice_date_invalid"]),
    ({"invoice_date": "2024-01-01 junk"}, ["invoice_date_invalid"]),
    ({"invoice_date": "2024-01-01Tjunk"}, ["invoice_date_invalid"]),
    ({"invoice_date": "2024-01-01T00:00:00"}, ["invoice_date_invalid"]),
    ({"invoice_date": "2024"}, ["invoice_date_invalid"]),
    ({"invoice_date": "2024-1"}, ["invoice_date_invalid"]),
    ({"amount": "1.0000000000000000001"}, ["amount_decimals"]),
    ({"amount": "1.0000000000000000000"}, []),
    ({"amount": "1.001e3"}, []),
    ({"amount": "1.0001e1"}, ["amount_decimals"]),
    ({"currency": None, "amount": "-2"}, ["amount_not_positive", "currency_form"]),
]


def test_row_contract(spark):
    good = dict(zip(INVOICE_COLUMNS, ("I", "V", "N", "2026-01-01", "10.00", "TRY", "", "B", "")))
    rows = [tuple((good | change)[c] for c in INVOICE_COLUMNS) for change, _ in CASES]
    schema = ", ".join(f"{c} string" for c in INVOICE_COLUMNS)
    checked = V.with_violations(spark.createDataFrame(rows, schema))
    assert [r["violations"] for r in checked.collect()] == [codes for _, codes in CASES]
    clean = sum(not codes for _, codes in CASES)
    assert V.accepted(checked).count() == clean
    assert V.quarantined(checked).count() == len(CASES) - clean


def test_csv_keeps_empty_fields_and_adds_groups(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        ",".join(INVOICE_COLUMNS) + ",note\n"
        'A,NA,INV-1,2026-01-01,10.50,TRY,,B,"a, ""b""",x\n'
    )
    row = read_csv(spark, str(path)).first()
    assert (row["po_number"], row["vendor_account_id"]) == ("", "NA")
    assert row["description"] == 'a, "b"' and row["group_id"] == "A" and row["note"] == "x"
    typed = V.typed(read_csv(spark, str(path))).first()
    assert typed["amount"] == 10.5 and typed["invoice_date"] == date(2026, 1, 1)


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    line = 'A,V,INV-1,2026-01-01,10.50,TRY,,B,text'
    swapped = ["vendor_account_id", "invoice_id", *INVOICE_COLUMNS[2:]]
    (tmp_path / "a.csv").write_text(",".join(INVOICE_COLUMNS) + f"\n{line}\n")
    (tmp_path / "b.csv").write_text(",".join(INVOICE_COLUMNS) + f"\n{line}\n")
    assert read_csv(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.csv").write_text(",".join(swapped) + f"\n{line}\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).select("invoice_id", "vendor_account_id").collect()


def test_table_dates_may_carry_a_time(spark):
    values = ["2024-01-01", "2024-01-01 10:00:00", "2024-01-01T10:00:00Z", "2024-01-01 junk", "2024", "2024-1", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = [r[0] for r in df.select(V.as_date(F.col("d"))).collect()]
    assert got == [date(2024, 1, 1)] * 3 + [None] * 4


def test_json_batches(spark, tmp_path):
    base = dict(zip(INVOICE_COLUMNS, ("A", "V", "N", "2026-01-01", "10.00", "TRY", "", "B", "d")))
    other = {**base, "invoice_id": "B", "surprise": 1}
    del other["po_number"]
    (tmp_path / "batch.json").write_text(json.dumps({"invoices": [base, other]}, indent=1))
    rows = read_json_batches(spark, str(tmp_path / "batch.json"))
    checked = {r["invoice_id"]: r for r in V.with_violations(rows).collect()}
    assert checked["A"]["violations"] == [] and checked["A"]["group_id"] == "A"
    assert checked["B"]["violations"] == ["unknown_field"] and checked["B"]["po_number"] == ""


def test_quality_profile(spark):
    df = spark.createDataFrame(
        [invoice("A", "G1"), invoice("B", "G1", text=None), invoice("C", "G2", amount=-1.0)],
        INVOICE,
    )
    row = V.quality_profile(df).first().asDict()
    assert row == {
        "rows": 3,
        "unique_invoice_ids": 3,
        "null_cells": 1,
        "non_positive_amounts": 1,
        "date_min": date(2026, 1, 1),
        "date_max": date(2026, 1, 1),
        "duplicate_groups": 1,
    }
