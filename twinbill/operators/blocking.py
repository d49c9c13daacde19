"""Candidate pairs: a blocked self-join with a date band and, where it may be
used, an amount band.

Rows meet when they share a vendor account or a bank token, always within one
currency, and lie at most a given number of days apart. Both bands are part of
the join key (cells plus neighbours), so a task holds one block's rows of a
limited period and never a whole block. Cells that are still large are cut into
a grid of smaller ones; no pair is lost or repeated by that. Where no such cell
and no amount band tells the sides apart, both read the same exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbill.functions.pairmath import AMOUNT_FLOOR, amount_gap, same_group
from twinbill.functions.similarity import certain, marks, multiset_bound, similarity
from twinbill.functions.text import digit_signature, normalize_identifier
from twinbill.operators.validate import label_columns
from twinbill.params import TriageParams
from twinbill.session import materialize

BLOCKS = {"vendor": "vendor_account_id", "bank": "bank_fingerprint"}

# Rows of one side of a join cell that one task should face at most.
CELL_ROWS = 20_000
# A cell spans so many times the date band: the wider, the fewer rows are copied to the next cell and the more pairs are tested.
CELL_BANDS = 3
BLOCK_KEYS = ("block", "block_value", "currency")


def prepare(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-invoice columns the pair step needs, computed once before the join."""
    norm = normalize_identifier(F.col("invoice_number"))
    return df.select(
        "invoice_id",
        "vendor_account_id",
        "bank_fingerprint",
        "currency",
        "invoice_date",
        F.col("amount").cast("double").alias("amount"),
        "po_number",
        norm.alias("number_norm"),
        normalize_identifier(F.col("description")).alias("description_norm"),
        *label_columns(df),
        *keep,
    ).withColumns(
        {
            "number_digits": digit_signature(F.col("number_norm")),
            "number_marks": marks(F.col("number_norm")),
            "description_marks": marks(F.col("description_norm")),
        }
    )


def written(rows: DataFrame) -> DataFrame:
    """Prepared rows, written once: the count of the blocks and both sides of the join read them."""
    kept = [c for c in ("number_marks", "description_marks") if c in rows.columns]
    return materialize(rows, "prepared").withColumns({c: certain(F.col(c)) for c in kept})


def blocked(rows: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """One copy of each row per block it belongs to."""
    keys = [
        F.struct(F.lit(name).alias("block"), F.col(BLOCKS[name]).alias("block_value"))
        for name in blocks
    ]
    return rows.select("*", F.inline(F.array(*keys)))


def day_bucket(days: int) -> Column:
    return F.floor(F.datediff("invoice_date", F.lit("1970-01-01").cast("date")) / days)


def day_cells(rows: DataFrame, max_days: int) -> DataFrame:
    """Each row in the cell of its day and, where ``max_days`` more lead into the next cell, ``copied`` to that one."""
    width = CELL_BANDS * max_days
    day = F.datediff("invoice_date", F.lit("1970-01-01").cast("date"))
    home, reached = F.floor(day / width), F.floor((day + max_days) / width)

    def cell(at: Column, copied: bool) -> Column:
        return F.struct(at.alias("day_cell"), F.lit(copied).alias("copied"))

    cells = F.when(reached > home, F.array(cell(home, False), cell(reached, True))).otherwise(F.array(cell(home, False)))
    return rows.select("*", F.inline(cells))


def amount_bucket(max_gap: float) -> Column:
    """Amounts within the gap lie in the same or a neighbouring logarithmic bucket.

    The widening keeps rounding from separating borderline pairs.
    """
    width = -math.log1p(-max(max_gap, 1e-6)) * (1 + 1e-6)
    return F.floor(F.log(F.greatest(F.col("amount"), F.lit(AMOUNT_FLOOR))) / width)


def grid(rows: DataFrame, side: str) -> DataFrame:
    """Copies of each row for the cells of its ``cuts`` x ``cuts`` grid: one line of it for a side."""
    cuts = F.coalesce(F.col("cuts"), F.lit(1))
    own = F.pmod(F.xxhash64("invoice_id"), cuts)
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), cuts.cast("bigint") - 1))
    other = "right" if side == "left" else "left"
    return rows.withColumn(f"{side}_cut", own).withColumn(f"{other}_cut", others)


def _side(rows: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return rows.select(
        *keys, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keys]
    )


def crowded_blocks(cells: DataFrame, rows: int) -> DataFrame:
    """Blocks with more than ``rows`` rows; there are few blocks, so the counts collapse on the map side."""
    counted = cells.groupBy(*BLOCK_KEYS).agg(F.count("*").alias("members"))
    return counted.filter(F.col("members") > rows).select(*BLOCK_KEYS)


def large_groups(
    cells: DataFrame, keys: list[str], rows: int, crowded: DataFrame | None = None
) -> DataFrame:
    """Cells (by ``keys``) with more than ``rows`` rows, counted in crowded blocks only."""
    if crowded is None:
        crowded = materialize(crowded_blocks(cells, rows), "blocks")
    counted = (
        cells.join(crowded.select(*BLOCK_KEYS), list(BLOCK_KEYS), "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("members"))
    )
    return counted.filter(F.col("members") > rows)


def _oversize(
    cells: DataFrame, keys: list[str], cell_rows: int, crowded: DataFrame | None
) -> DataFrame | None:
    """Cells with more rows than a task should face, and the cuts they need.

    Whole blocks are counted first, unless a census has done so: only blocks
    above the bound can hold a large cell. The result is a written table, so
    Spark broadcasts it by its size in bytes or joins it by a shuffle.
    """
    if crowded is None:
        crowded = materialize(crowded_blocks(cells, cell_rows), "blocks")
    if crowded.isEmpty():
        return None
    found = large_groups(cells, keys, cell_rows, crowded)
    large = materialize(
        found.select(*keys, F.ceil(F.col("members") / cell_rows).cast("int").alias("cuts")), "cells"
    )
    return None if large.isEmpty() else large


def band_pairs(
    rows: DataFrame,
    *,
    max_days: int,
    max_gap: float | None = None,
    blocks: tuple[str, ...] = ("vendor", "bank"),
    within: tuple[str, ...] = (),
    where: Column | None = None,
    cell_rows: int | None = CELL_ROWS,
    crowded: DataFrame | None = None,
) -> DataFrame:
    """Unordered pairs of rows in a common block within the bands.

    The left side is the earlier one by (date, id). A pair sharing both vendor
    and bank appears under the vendor block only. Output columns carry the
    prefixes ``left_`` and ``right_``; ``within`` names extra columns both
    sides must agree on, ``where`` an extra predicate on the pair. ``max_gap``
    below 1 adds the amount band. ``cell_rows=None`` skips the skew check,
    which reads the keys once ahead of the join; ``crowded`` names the blocks
    with more than ``cell_rows`` rows where they are known already.
    """
    keys = ["block", "block_value", "currency", *within, "day_cell"]
    left = right = day_cells(blocked(rows, blocks), max_days)
    if max_gap is not None and max_gap < 1:
        left = left.withColumn("amount_bucket", amount_bucket(max_gap))
        keys.append("amount_bucket")
        near = [F.col("amount_bucket") + step for step in (-1, 0, 1)]
        right = left.filter(~F.col("copied")).withColumn("amount_bucket", F.explode(F.array(*near)))

    cells = left.select(*keys)
    if "amount_bucket" in keys:
        # a neighbouring amount bucket may crowd the right side only
        cells = cells.unionByName(right.select(*keys))
    large = _oversize(cells, keys, cell_rows, crowded) if cell_rows else None
    if large is not None:
        right = right.filter(~F.col("copied"))
        left = grid(left.join(large, keys, "left"), "left").drop("cuts")
        right = grid(right.join(large, keys, "left"), "right").drop("cuts")
        keys = [*keys, "left_cut", "right_cut"]

    earlier = (F.col("left_invoice_date") < F.col("right_invoice_date")) | (
        (F.col("left_invoice_date") == F.col("right_invoice_date"))
        & (F.col("left_invoice_id") < F.col("right_invoice_id"))
    )
    # a later row meets the rows of its own cell and those copied there; two copies meet in the cell before as well
    wanted = ~(F.col("left_copied") & F.col("right_copied")) & earlier & (
        F.datediff(F.col("right_invoice_date"), F.col("left_invoice_date")) <= max_days
    )
    if "bank" in blocks:
        wanted = wanted & (
            (F.col("block") == "vendor")
            | (F.col("left_vendor_account_id") != F.col("right_vendor_account_id"))
        )
    if "amount_bucket" in keys:
        wanted = wanted & (amount_gap(F.col("left_amount"), F.col("right_amount")) <= max_gap)
    if where is not None:
        wanted = wanted & where
    joined = _side(left, "left", keys).join(_side(right, "right", keys), keys).filter(wanted)
    dropped = [k for k in keys if k not in ("block", "currency", *within)]
    return joined.drop(*dropped, "left_copied", "right_copied")


def amount_close(params: TriageParams) -> Column:
    return (
        amount_gap(F.col("left_amount"), F.col("right_amount")) <= params.max_amount_relative_gap
    )


# Texts that are compared, the marks that bound their similarity, and whether only digits of those count.
BOUNDS = {
    "number_norm": ("number_marks", False),
    "number_digits": ("number_marks", True),
    "description_norm": ("description_marks", False),
}


def text_bound(name: str) -> Column:
    """Native upper bound of the similarity of both sides' ``name``."""
    of, digits_only = BOUNDS[name]
    columns = [F.col(f"{side}_{c}") for c in (name, of) for side in ("left", "right")]
    return multiset_bound(*columns, digits_only)


def reachable(params: TriageParams) -> Column:
    """Native test that keeps every pair the amount-or-number rule can keep."""
    return amount_close(params) | (text_bound("number_norm") >= params.min_invoice_similarity)


def with_label(pairs: DataFrame) -> DataFrame:
    if "left_group_id" not in pairs.columns:
        return pairs
    return pairs.withColumn(
        "label", same_group(F.col("left_group_id"), F.col("right_group_id"))
    )


def sided_pairs(
    df: DataFrame,
    params: TriageParams,
    order: str | None = None,
    prepared: DataFrame | None = None,
    **band_options,
) -> DataFrame:
    """Labelled pairs in the date band, sides in ledger or in ``order`` order.

    ``prepared`` are the rows of ``df`` after ``prepare``, where they are written already.
    """
    extra = (*band_options.get("within", ()), *((order,) if order else ()))
    if prepared is None:
        # descriptions are bounded by a model only
        prepared = written(prepare(df, extra).drop("description_marks"))
    pairs = band_pairs(prepared, max_days=params.max_date_gap_days, **band_options)
    return with_label(arrange_sides(pairs, order) if order else pairs)


def candidate_pairs(
    df: DataFrame, params: TriageParams = TriageParams(), order: str | None = None, **band_options
) -> DataFrame:
    """Ids (and label, and the columns of ``within``) of the pairs that survive the amount-or-number rule."""
    pairs = sided_pairs(df, params, order, where=reachable(params), **band_options)
    number = similarity(
        F.col("left_number_norm"), F.col("right_number_norm"), needed=~amount_close(params)
    )
    kept = pairs.filter(amount_close(params) | (number >= params.min_invoice_similarity))
    return kept.select(
        *band_options.get("within", ()),
        "left_invoice_id",
        "right_invoice_id",
        *(["label"] if "label" in pairs.columns else []),
    )


def lookup_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach both invoices to an external table of id pairs."""
    left = rows.select([F.col(c).alias(f"left_{c}") for c in rows.columns])
    right = rows.select([F.col(c).alias(f"right_{c}") for c in rows.columns])
    return pairs.join(left, "left_invoice_id").join(right, "right_invoice_id")


def arrange_sides(pairs: DataFrame, order: str) -> DataFrame:
    """Swap the sides where the left one is later by another order column.

    The join pairs rows in date order; a table with an order of its own (kept
    as ``order``) gets its sides back by this.
    """
    swap = F.col(f"left_{order}") > F.col(f"right_{order}")
    sided = [c[len("left_") :] for c in pairs.columns if c.startswith("left_")]
    flipped = {}
    for name in sided:
        a, b = F.col(f"left_{name}"), F.col(f"right_{name}")
        flipped[f"left_{name}"] = F.when(swap, b).otherwise(a)
        flipped[f"right_{name}"] = F.when(swap, a).otherwise(b)
    return pairs.withColumns(flipped)


def candidate_recall(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of duplicate groups found: positive pairs over groups with more
    than one record (1.0 if there are none), and beside it the share of those
    groups with at least one pair."""
    return recall_by(df, pairs, [])


def recall_by(df: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Candidate recall per ``by`` column (needs ``left_group_id`` and label)."""
    repeated = (
        df.groupBy(*by, "group_id")
        .agg(F.count("*").alias("records"))
        .select(
            *by,
            F.when(F.col("records") > 1, 1).otherwise(0).alias("group"),
            F.lit(0).cast("bigint").alias("pairs"),
        )
    )
    found = (
        pairs.filter("label = 1")
        .groupBy(*by, F.col("left_group_id").cast("string").alias("group_id"))
        .agg(F.count("*").alias("pairs"))
        .select(*by, F.lit(0).alias("group"), "pairs")
    )
    counts = (
        repeated.unionByName(found)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("group"), F.lit(0)).alias("groups"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("positive_pairs"),
            F.count_if(F.col("pairs") > 0).alias("groups_found"),
        )
    )

    def share(count: str) -> Column:
        return F.when(F.col("groups") == 0, 1.0).otherwise(
            F.least(F.lit(1.0), F.col(count) / F.col("groups"))
        )

    return counts.select(
        *by,
        "groups",
        "positive_pairs",
        share("positive_pairs").alias("candidate_recall"),
        share("groups_found").alias("group_recall"),
    )
