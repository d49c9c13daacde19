"""Scoring pairs with a linear model: probability, policy, evidence."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbill.functions import pairmath as M
from twinbill.operators.blocking import text_bound
from twinbill.operators.features import COMPARED, exact_signature, native_features, sides
from twinbill.params import TriageParams
from twinbill.schema import FEATURE_NAMES

# Decision states and the action text of each.
ACTIONS = {
    "HOLD": "Pause payment and request two-record verification.",
    "REVIEW": "Queue for accounts-payable analyst review before payment.",
    "PASS": "No candidate exceeded the review threshold; retain normal controls.",
}
EVIDENCE_ITEMS = 4

_SLACK = 1e-9


@dataclass(frozen=True)
class Model:
    """Standardised logistic regression with its frozen threshold."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficient: tuple[float, ...]
    intercept: float
    threshold: float = 0.5
    feature_names: tuple[str, ...] = FEATURE_NAMES
    synthetic_training_data: bool = True

    def terms(self):
        return zip(self.feature_names, self.mean, self.scale, self.coefficient, strict=True)


def contribution(value: Column, mean: float, scale: float, coefficient: float) -> Column:
    return (value - F.lit(mean)) / F.lit(scale) * F.lit(coefficient)


def margin(model: Model, features: dict[str, Column] | None = None) -> Column:
    total = F.lit(model.intercept)
    for name, mean, scale, coefficient in model.terms():
        value = features[name] if features else F.col(name)
        total = total + contribution(value, mean, scale, coefficient)
    return total


def probability(model: Model) -> Column:
    return 1.0 / (1.0 + F.exp(-margin(model)))


def decide(score: Column, threshold: float) -> Column:
    """Struct (state, action)."""
    state = (
        F.when(exact_signature() & (score >= threshold), "HOLD")
        .when(score >= threshold, "REVIEW")
        .otherwise("PASS")
    )
    return with_action(state)


def with_action(state: Column) -> Column:
    action = F.when(state == "HOLD", ACTIONS["HOLD"]).when(state == "REVIEW", ACTIONS["REVIEW"])
    return F.struct(
        state.alias("state"), action.otherwise(ACTIONS["PASS"]).alias("action")
    )


def evidence(model: Model) -> Column:
    """The largest signed contributions of a pair, ties in feature order.

    ``sort_array`` orders as ``array_sort`` does here, without a comparator called for each two items;
    values are rounded only where they are shown.
    """
    items = []
    for position, (name, mean, scale, coefficient) in enumerate(model.terms()):
        part = M.round6(contribution(F.col(name), mean, scale, coefficient))
        items.append(
            F.struct(
                (-F.abs(part)).alias("rank"),
                F.lit(position).alias("position"),
                F.lit(name).alias("feature"),
                F.col(name).alias("value"),
                part.alias("contribution"),
            )
        )
    ranked = F.slice(F.sort_array(F.array(*items)), 1, EVIDENCE_ITEMS)
    return F.transform(
        ranked,
        lambda item: F.struct(item["feature"], M.round6(item["value"]).alias("value"), item["contribution"]),
    )


@dataclass(frozen=True)
class Reach:
    """How far apart two invoices may be and still reach the threshold."""

    max_days: int
    max_gap: float | None
    blocks: tuple[str, ...]


def threshold_margin(model: Model) -> float:
    """Margin below which no probability reaches the threshold."""
    if model.threshold <= 0:
        return -math.inf
    if model.threshold >= 1:
        # a probability of exactly 1 needs a margin beyond double precision
        return 30.0
    return math.log(model.threshold / (1 - model.threshold)) - _SLACK


def reach(model: Model, params: TriageParams) -> Reach:
    """Bands implied by model and threshold.

    Every feature lies in [0, 1], so with all others at their best, each one
    must itself stay above some value. Turning that into day and amount bands
    keeps pairs that could only PASS out of the join; no flagged pair is lost.
    """
    best: dict[str, float] = {}
    terms = {name: (mean, scale, coef) for name, mean, scale, coef in model.terms()}
    for name, (mean, scale, coef) in terms.items():
        ends = [(x - mean) / scale * coef for x in (0.0, 1.0)]
        best[name] = ends[1] if name == "currency_same" else max(ends)
    spare = model.intercept + sum(best.values()) - threshold_margin(model)

    def least(name: str) -> float:
        """Smallest value of a feature that can still reach the threshold."""
        mean, scale, coef = terms[name]
        if coef <= 0 or not math.isfinite(spare):
            return 0.0
        return min(1.0, max(0.0, 1.0 - spare * scale / coef - _SLACK))

    days = params.max_date_gap_days
    nearness = least("date_proximity")
    if nearness > 0:
        days = min(days, math.floor(-M.DATE_DECAY_DAYS * math.log(nearness) + 1e-6))
    least_amount = least("amount_relative_similarity")
    gap = 1.0 - least_amount if least_amount > 0 else None
    blocks = ("vendor",) if least("vendor_same") > 0 else ("vendor", "bank")
    return Reach(max(days, 1), gap, blocks)


def may_reach(model: Model) -> Column:
    """Native test that keeps every pair whose probability can reach the
    threshold: exact values where they are plain arithmetic, bounds for the
    text similarities."""
    features = native_features()
    for name, mean, scale, coefficient in model.terms():
        if name in COMPARED:
            left, right = sides(COMPARED[name])
            if coefficient >= 0:
                features[name] = F.when(left == right, 1.0).otherwise(text_bound(COMPARED[name]))
            else:
                features[name] = F.when(left == right, 1.0).otherwise(0.0)
    return margin(model, features) >= threshold_margin(model)


def score(features: DataFrame, model: Model) -> DataFrame:
    """Adds ``probability`` to a table with the nine features."""
    return features.withColumn("probability", probability(model))
