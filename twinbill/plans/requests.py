"""Triage of request batches: every document is judged by itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbill.operators import validate as V
from twinbill.operators.blocking import candidate_pairs, prepare, written
from twinbill.operators.scoring import Model
from twinbill.params import TriageParams
from twinbill.plans.triage import flagged_pairs
from twinbill.session import materialize

BATCH = ("batch_id",)


@dataclass(frozen=True)
class RequestTriage:
    """Matches with their batch, refused batches with reasons, counts of every accepted batch, and one row
    for every document read: where it stands, whether it was accepted, its reasons and its counts."""

    matches: DataFrame
    refused: DataFrame
    summary: DataFrame
    documents: DataFrame


def triage_requests(
    invoices: DataFrame,
    model: Model,
    params: TriageParams = TriageParams(),
    pepper: str = "",
) -> RequestTriage:
    """Contract, unique ids within a batch, and triage within a batch.

    ``invoices`` are rows of ``read_json_batches``. A batch that could not be
    read, has a broken invoice or repeats an id is refused as a whole; its rows are in no pair.
    """
    reasons = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.col("violations"))
    checked = materialize(V.with_violations(invoices).withColumn("violations", reasons), "requests")
    broken = (
        checked.where(F.size("violations") > 0)
        .select(*BATCH, "invoice_id", F.explode("violations").alias("reason"))
    )
    repeated = (
        checked.where("problem is null")
        .groupBy(*BATCH, "invoice_id")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
        .select(*BATCH, "invoice_id", F.lit("invoice_id_repeated").alias("reason"))
    )
    refused = materialize(broken.unionByName(repeated).distinct(), "refused")
    rows = checked.drop("violations", "unknown_fields", "problem", "document")
    good = V.typed(rows.join(refused.select(*BATCH).distinct(), list(BATCH), "left_anti"), strict=True)
    good = materialize(good, "requests")
    rows = written(prepare(good, BATCH))
    matches = flagged_pairs(good, model, params, pepper, within=BATCH, prepared=rows)
    reviewed = candidate_pairs(good, params, within=BATCH, prepared=rows).select(
        *BATCH, F.lit(1).alias("reviewed"), F.lit(0).alias("flagged")
    )
    flagged = matches.select(*BATCH, F.lit(0).alias("reviewed"), F.lit(1).alias("flagged"))
    pairs = reviewed.unionByName(flagged).groupBy(*BATCH).agg(
        F.sum("reviewed").alias("reviewed_pairs"), F.sum("flagged").alias("flagged_pairs")
    )
    summary = (
        good.groupBy(*BATCH)
        .agg(F.count("*").alias("invoices"))
        .join(pairs, list(BATCH), "left")
        .na.fill(0, ["reviewed_pairs", "flagged_pairs"])
    )
    return RequestTriage(matches, refused, summary, document_report(checked, refused, pairs))


def document_report(checked: DataFrame, refused: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for every document: place, outcome, distinct reasons in order, invoices and pairs."""
    held = checked.groupBy(*BATCH).agg(
        F.first("document").alias("document"), F.count_if(F.col("problem").isNull()).alias("invoices")
    )
    # as many entries at most as there are codes
    why = refused.groupBy(*BATCH).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return (
        held.join(why, list(BATCH), "left")
        .join(pairs, list(BATCH), "left")
        .na.fill(0, ["reviewed_pairs", "flagged_pairs"])
        .select(
            *BATCH,
            "document.*",
            F.when(F.col("reasons").isNull(), "accepted").otherwise("refused").alias("outcome"),
            F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
            "invoices",
            "reviewed_pairs",
            "flagged_pairs",
        )
    )
