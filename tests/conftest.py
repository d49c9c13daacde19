import os
import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from twinbill.session import materialize  # noqa: E402
from twinbill.sources.ledger import labelled_ledger  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

INVOICE = (
    "invoice_id string, group_id string, vendor_account_id string, invoice_number string, "
    "invoice_date date, amount double, currency string, po_number string, "
    "bank_fingerprint string, description string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    return materialize(labelled_ledger(spark, SF_DIR), "ledger")


def invoice(invoice_id, group="G", number="INV-1", day=date(2026, 1, 1), amount=100.0,
            vendor="SUP-1", currency="TRY", po="PO-1", bank="BANK-1", text="service"):
    return (invoice_id, group, vendor, number, day, amount, currency, po, bank, text)


@pytest.fixture(scope="session")
def small(spark):
    """Two records of one invoice and another invoice of the same vendor."""
    return spark.createDataFrame(
        [
            invoice("A", "G1", "INV-100", date(2026, 1, 1), 1000.0, text="cloud service"),
            invoice("B", "G1", "inv100", date(2026, 1, 3), 1000.0, text="cloud service"),
            invoice("C", "G2", "INV-999", date(2026, 1, 4), 1000.0, po="PO-2",
                    text="office supplies"),
        ],
        INVOICE,
    )
