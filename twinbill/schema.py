"""Column sets and Spark schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

# The invoice contract.
INVOICE_COLUMNS = (
    "invoice_id",
    "vendor_account_id",
    "invoice_number",
    "invoice_date",
    "amount",
    "currency",
    "po_number",
    "bank_fingerprint",
    "description",
)
LABEL_COLUMNS = ("group_id", "is_duplicate_record", "duplicate_type")

# The model's feature order.
FEATURE_NAMES = (
    "vendor_same",
    "bank_same",
    "currency_same",
    "invoice_similarity",
    "digit_similarity",
    "amount_relative_similarity",
    "date_proximity",
    "po_same",
    "description_similarity",
)

STRICT_AMOUNT = T.DecimalType(12, 2)
