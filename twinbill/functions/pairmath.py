"""Arithmetic on the two sides of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amount floor, decay of date proximity, exact-amount tolerance.
AMOUNT_FLOOR = 0.01
DATE_DECAY_DAYS = 30.0
EXACT_AMOUNT = 0.999999


def amount_gap(left: Column, right: Column) -> Column:
    return F.abs(left - right) / F.greatest(left, right, F.lit(AMOUNT_FLOOR))


def amount_similarity(left: Column, right: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - amount_gap(left, right))


def day_gap(left: Column, right: Column) -> Column:
    return F.abs(F.datediff(left, right))


def date_proximity(left: Column, right: Column) -> Column:
    return F.exp(-day_gap(left, right) / DATE_DECAY_DAYS)


def flag(condition: Column) -> Column:
    return condition.cast("double")


def po_same(left: Column, right: Column) -> Column:
    return flag((left != "") & (left == right))


def same_group(left: Column, right: Column) -> Column:
    """Label: group ids compared as text."""
    return (left.cast("string") == right.cast("string")).cast("int")


def round6(value: Column) -> Column:
    """Six places, half to even."""
    return F.bround(value, 6)
