"""Sources that lose nothing: malformed CSV rows, unreadable and equal documents, moments that do not exist."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_model import MODEL
from twinbill.operators import validate as V
from twinbill.params import TriageParams
from twinbill.plans.requests import triage_requests
from twinbill.schema import INVOICE_COLUMNS
from twinbill.sources.files import csv_quarantine, read_csv, read_documents, read_json_batches

HEADER = ",".join(INVOICE_COLUMNS)


def line(i, *more, fields=9):
    values = [i, "V", "INV-1", "2026-01-01", "10.00", "TRY", "", "B", '"cloud, ""big"""']
    return ",".join([*values[:fields], *more])


def row(i, **change):
    values = (i, "V", "INV-1", "2026-01-01", "10.00", "TRY", "", "B", "cloud service")
    return dict(zip(INVOICE_COLUMNS, values, strict=True)) | change


@pytest.fixture
def malformed(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, line("A"), line("B", "x", "y"), "", line("C", fields=5), line("D")]))
    (folder / "b.csv").write_text("\n".join([HEADER, line("E"), line("F", fields=1)]))
    return str(folder)


def test_rows_that_do_not_match_the_header_are_set_apart(spark, malformed):
    good = read_csv(spark, malformed, malformed="separate")
    assert sorted(r["invoice_id"] for r in good.collect()) == ["A", "D", "E"] and good.count() == 3
    assert {r["description"] for r in good.collect()} == {'cloud, "big"'}
    assert {r["po_number"] for r in good.collect()} == {""}
    bad = csv_quarantine(spark, malformed)
    found = {(r["row_text"][0], r["fields"], r["expected"], r["reason"], r["file"][-5:]) for r in bad.collect()}
    assert found == {
        ("B", 11, 9, "too_many_fields", "a.csv"),
        ("C", 5, 9, "too_few_fields", "a.csv"),
        ("F", 1, 9, "too_few_fields", "b.csv"),
    }
    assert bad.count() == 3 and bad.select("reason").distinct().count() == 2


def test_a_malformed_row_fails_the_query_by_default(spark, malformed):
    for read in (lambda df: df.count(), lambda df: df.select("amount").collect(), lambda df: df.collect()):
        with pytest.raises(Exception, match="malformed CSV row"):
            read(read_csv(spark, malformed))
    with pytest.raises(ValueError):
        read_csv(spark, malformed, malformed="ignore")


def test_clean_and_empty_files(spark, tmp_path):
    (tmp_path / "clean.csv").write_text("\n".join([HEADER, line("A")]))
    (tmp_path / "empty.csv").write_text(HEADER)
    assert read_csv(spark, str(tmp_path / "clean.csv")).count() == 1
    assert csv_quarantine(spark, str(tmp_path / "clean.csv")).isEmpty()
    assert read_csv(spark, str(tmp_path / "empty.csv")).isEmpty()
    assert csv_quarantine(spark, str(tmp_path / "empty.csv")).isEmpty()


def test_every_document_is_judged(spark, tmp_path):
    good = json.dumps({"invoices": [row("A"), row("B", invoice_number="inv1")]})
    documents = [
        good,
        good,  # equal, and yet a document of its own
        good[:-25],  # cut off
        json.dumps({"invoices": "none"}),
        json.dumps({"invoices": []}),
        "{}",
        "17",
        json.dumps({"invoices": [row("A")], "note": "x"}),
        '{"invoices": [null]}',
        "   ",
    ]
    (tmp_path / "in.json").write_text("\n".join(documents))
    rows = read_json_batches(spark, str(tmp_path / "in.json"), multiline=False)
    out = triage_requests(rows, MODEL, TriageParams(), "p")
    report = [(r["line"], r["outcome"], r["reasons"], r["invoices"]) for r in out.documents.orderBy("line").collect()]
    assert [r[:3] for r in report[:8]] == [
        (0, "accepted", []),
        (1, "accepted", []),
        (2, "refused", ["document_unreadable"]),
        (3, "refused", ["document_unreadable"]),
        (4, "refused", ["no_invoices"]),
        (5, "refused", ["no_invoices"]),
        (6, "refused", ["document_unreadable"]),
        (7, "refused", ["unknown_document_field"]),
    ]
    assert len(report) == 9 and report[8][1] == "refused" and "invoice_id_length" in report[8][2]
    assert [r[3] for r in report[:3]] == [2, 2, 0]
    assert out.summary.count() == 2 and out.matches.count() == 2
    assert out.matches.select("batch_id").distinct().count() == 2


def test_identity_is_the_place_of_a_document(spark, tmp_path):
    """Many blocks of one file, and equal files: ids are unique and the same in every read."""
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("\n".join([json.dumps({"invoices": [row("A")]})] * 400))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16_000)
    try:
        reads = [read_documents(spark, str(tmp_path), multiline=False).collect() for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids = [{r["batch_id"] for r in read} for read in reads]
    assert ids[0] == ids[1] and len(ids[0]) == len(reads[0]) == 800
    assert len({(r["document"]["file"], r["document"]["block_start"]) for r in reads[0]}) > 4
    assert min(r["document"]["line"] for r in reads[0]) == 0
    whole = read_documents(spark, str(tmp_path)).collect()
    assert len(whole) == 2 and all(r["document"]["line"] == 0 for r in whole)


@pytest.mark.parametrize(
    ("text", "fine"),
    [
        ("2024-02-29", True), ("2023-02-29", False), ("2024-01-01 99:99", False), ("2024-01-01T23:59:59.123456", True),
        ("2024-01-01 24:00", False), ("2024-01-01T10:00:61", False), ("2024-01-01 10:00+05:30", True),
        ("2024-01-01 10:00+99:00", False), ("2024-01-01T10:00:00Z", True), ("2024-1-1", False), ("", False),
        ("2024-01-01 10:00:00+0530", True),
    ],
)
def test_moments_that_do_not_exist_are_no_dates(spark, text, fine):
    value = spark.createDataFrame([(text,)], "t string").select(V.as_date(F.col("t")).alias("d")).first()["d"]
    assert (value is not None) == fine and (not fine or value.isoformat() == text[:10])


def test_infinite_amounts_are_no_amounts(spark):
    rows = spark.createDataFrame([tuple(row("A", amount=a).values()) for a in ("inf", "-Infinity", "NaN", "1e3", "5")], list(INVOICE_COLUMNS))
    assert V.check_profile(rows, labels=False).first()["bad_amounts"] == 3
