"""The nine pair features and the exact-key rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbill.functions import pairmath as M
from twinbill.functions.similarity import similarity
from twinbill.operators.blocking import amount_close, band_pairs, prepare, reachable
from twinbill.operators.blocking import sided_pairs, with_label
from twinbill.params import TriageParams
from twinbill.schema import FEATURE_NAMES

# Similarity features and the prepared column each one compares.
COMPARED = {
    "invoice_similarity": "number_norm",
    "digit_similarity": "number_digits",
    "description_similarity": "description_norm",
}


def sides(name: str) -> tuple[Column, Column]:
    return F.col(f"left_{name}"), F.col(f"right_{name}")


def native_features() -> dict[str, Column]:
    """The six features that are plain column arithmetic."""
    return {
        "vendor_same": M.flag(_equal("vendor_account_id")),
        "bank_same": M.flag(_equal("bank_fingerprint")),
        "currency_same": F.lit(1.0),  # pairs never cross currencies
        "amount_relative_similarity": M.amount_similarity(*sides("amount")),
        "date_proximity": M.date_proximity(*sides("invoice_date")),
        "po_same": M.po_same(*sides("po_number")),
    }


def _equal(name: str) -> Column:
    left, right = sides(name)
    return left == right


def similarity_features() -> dict[str, Column]:
    """The three text similarities; Spark evaluates them in one Arrow pass."""
    return {name: similarity(*sides(column)) for name, column in COMPARED.items()}


def with_features(pairs: DataFrame, params: TriageParams) -> DataFrame:
    """Adds the nine features and drops pairs the amount-or-number rule drops."""
    scored = pairs.withColumns({**native_features(), **similarity_features()})
    return scored.filter(
        amount_close(params) | (F.col("invoice_similarity") >= params.min_invoice_similarity)
    )


def pair_features(
    df: DataFrame, params: TriageParams = TriageParams(), order: str | None = None, **band_options
) -> DataFrame:
    """Candidate pairs with features in the model's order, label and exposure."""
    pairs = sided_pairs(df, params, order, where=reachable(params), **band_options)
    scored = with_features(pairs, params)
    extra = ["left_group_id", "label"] if "label" in scored.columns else []
    if "left_duplicate_type" in scored.columns and "left_is_duplicate_record" in scored.columns:
        scored = scored.withColumn("pair_type", pair_type())
        extra.append("pair_type")
    return scored.withColumn("exposure", exposure()).select(
        *band_options.get("within", ()),
        "left_invoice_id",
        "right_invoice_id",
        *FEATURE_NAMES,
        "exposure",
        *extra,
    )


def exposure() -> Column:
    """Money at stake in a pair: the left amount."""
    return F.greatest(F.col("left_amount"), F.lit(0.0))


def pair_type() -> Column:
    """Duplicate type of the pair's copy: the right one's if that is one, else the left one's.

    The left flag decides nothing, but a side that lacked it would need an exchange of its own.
    """
    left = F.coalesce(F.col("left_is_duplicate_record"), F.lit(False)).cast("int")
    right = F.when(F.col("right_is_duplicate_record"), 2).otherwise(-1)
    ranked = [
        F.struct(rank.alias("rank"), F.col(f"{side}_duplicate_type").alias("kind"))
        for side, rank in (("left", left), ("right", right))
    ]
    return F.greatest(*ranked)["kind"]


def exact_signature() -> Column:
    """Same vendor, same normalised number, effectively the same amount."""
    return (
        (F.col("vendor_same") == 1)
        & (F.col("invoice_similarity") == 1)
        & (F.col("amount_relative_similarity") >= M.EXACT_AMOUNT)
    )


def exact_baseline() -> Column:
    return exact_signature().cast("int")


def exact_key_pairs(df: DataFrame, params: TriageParams = TriageParams()) -> DataFrame:
    """Pairs with the exact signature, joined on it directly.

    A similarity of 1 means equal text, so the normalised number belongs into
    the join key and no similarity is computed. Equal numbers always pass the
    amount-or-number rule, whatever its amount gap is.
    """
    pairs = band_pairs(
        prepare(df),
        max_days=params.max_date_gap_days,
        blocks=("vendor",),
        within=("number_norm",),
        where=M.amount_similarity(*sides("amount")) >= M.EXACT_AMOUNT,
    )
    return with_label(pairs)
