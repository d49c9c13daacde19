"""Leakage-free time split, ledger order and the stratified sample."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbill.operators.ranges import in_order, with_place
from twinbill.session import materialize

# Split names, cumulative shares, rows per stratum of the sample.
SPLITS = ("train", "validation", "test")
TRAIN_SHARE = 0.70
VALIDATION_SHARE = 0.85
SAMPLE_ROWS = 60


@dataclass(frozen=True)
class Cut:
    """Last group, by (anchor date, group id), before a split boundary."""

    anchor: date | None
    group_id: str | None

    def covers(self, anchor: Column, group_id: Column) -> Column:
        if self.anchor is None:
            return F.lit(False)
        day = F.lit(self.anchor)
        return (anchor < day) | ((anchor == day) & (group_id <= F.lit(self.group_id)))


def anchors(df: DataFrame) -> DataFrame:
    """First date of each group."""
    return df.groupBy("group_id").agg(F.min("invoice_date").alias("anchor"))


def nth_smallest(df: DataFrame, column: str, n: int) -> str:
    """The n-th smallest value (from 1) of a column, by a distributed sort.

    Sorted rows are written once; each partition's size then tells which one
    holds the n-th row and at which offset.
    """
    numbered = materialize(
        df.select(column)
        .orderBy(column)
        .select(
            column,
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("offset"),
        ),
        "order",
    )
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size")).orderBy("part").collect()
    left = n - 1
    for row in sizes:
        if left < row["size"]:
            return numbered.filter(
                (F.col("part") == row["part"]) & (F.col("offset") == left)
            ).first()[column]
        left -= row["size"]
    raise ValueError("fewer rows than asked for")


def split_cuts(groups: DataFrame) -> tuple[Cut, Cut]:
    """Boundaries of the 70/15/15 split over ``anchors`` in date order.

    Only one row per calendar date and the groups of a boundary date are
    looked at; ties on a date go by group id.
    """
    days = groups.groupBy("anchor").agg(F.count("*").alias("groups")).orderBy("anchor").collect()
    total = sum(row["groups"] for row in days)
    cuts = []
    for share in (TRAIN_SHARE, VALIDATION_SHARE):
        left = int(total * share)
        cut = Cut(None, None)
        for row in days if left else []:
            if left <= row["groups"]:
                on_day = groups.filter(F.col("anchor") == F.lit(row["anchor"]))
                cut = Cut(row["anchor"], nth_smallest(on_day, "group_id", left))
                break
            left -= row["groups"]
        cuts.append(cut)
    return cuts[0], cuts[1]


def split_of(anchor: Column, group_id: Column, cuts: tuple[Cut, Cut]) -> Column:
    return (
        F.when(cuts[0].covers(anchor, group_id), SPLITS[0])
        .when(cuts[1].covers(anchor, group_id), SPLITS[1])
        .otherwise(SPLITS[2])
    )


def group_splits(df: DataFrame) -> DataFrame:
    """(group_id, anchor, split), one row per group.

    The anchors are written once, since the day counts, the boundary dates and
    the join back all read them.
    """
    groups = materialize(anchors(df), "anchors")
    return groups.withColumn(
        "split", split_of(F.col("anchor"), F.col("group_id"), split_cuts(groups))
    )


def temporal_split(df: DataFrame) -> DataFrame:
    """Every row with the split its whole group belongs to."""
    return df.join(group_splits(df).select("group_id", "split"), "group_id")


def overlapping_groups(split_rows: DataFrame) -> DataFrame:
    """Groups found in more than one split; empty by construction."""
    return (
        split_rows.groupBy("group_id")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter("first_split <> last_split")
    )


def ledger_order(df: DataFrame) -> DataFrame:
    return df.orderBy("invoice_date", "invoice_id")


def ledger_places(df: DataFrame, name: str = "place") -> DataFrame:
    """Every row with its place in ledger order, found without sorting the table in one task."""
    return with_place(in_order(df, F.col("invoice_date").asc(), F.col("invoice_id").asc()), name)


def stratified_sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows, in ledger order, of multi-record groups and of singletons.

    The rank limit is applied within each task before the two strata meet.
    """
    sizes = df.groupBy("group_id").agg((F.count("*") > 1).alias("is_multi"))
    in_order = Window.partitionBy("is_multi").orderBy("invoice_date", "invoice_id")
    return (
        df.join(sizes, "group_id")
        .withColumn("position", F.row_number().over(in_order))
        .filter(F.col("position") <= rows)
    )
