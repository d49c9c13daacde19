"""Registered queries: the flagship, every operator, and their SQL twins."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries as oracle  # noqa: E402
from twinbill.functions.pairmath import amount_gap  # noqa: E402
from twinbill.functions.text import (  # noqa: E402
    ascii_upper,
    digit_signature,
    normalize_identifier,
    safe_reference,
)
from twinbill.operators import blocking as B  # noqa: E402
from twinbill.operators import logistic as LG  # noqa: E402
from twinbill.operators import metrics as X  # noqa: E402
from twinbill.operators import split as S  # noqa: E402
from twinbill.operators import validate as V  # noqa: E402
from twinbill.operators.compare import differences, unequal_rows  # noqa: E402
from twinbill.operators.features import (  # noqa: E402
    exact_baseline,
    exact_key_pairs,
    exposure,
    native_features,
    pair_features,
    pair_type,
)
from twinbill.operators.ranges import in_order, laid_out, with_place  # noqa: E402
from twinbill.operators.scoring import Model, decide, evidence, score  # noqa: E402
from twinbill.params import TriageParams  # noqa: E402
from twinbill.plans.compare_runs import compare_runs  # noqa: E402
from twinbill.plans.requests import triage_requests  # noqa: E402
from twinbill.plans.score_csv import score_csv  # noqa: E402
from twinbill.plans.training import train_and_evaluate, write_run  # noqa: E402
from twinbill.plans.triage import flagged_pairs, triage  # noqa: E402
from twinbill.schema import FEATURE_NAMES, INVOICE_COLUMNS  # noqa: E402
from twinbill.session import materialize, scratch_path  # noqa: E402
from twinbill.sources.files import (  # noqa: E402
    csv_quarantine,
    read_csv,
    read_json_batches,
    write_json,
    write_sample,
)
from twinbill.sources.ledger import (  # noqa: E402
    base_ledger,
    inject,
    labelled_ledger,
    read_table,
)
from twinbill.sources.model_store import load_model, parameter_rows, save_model  # noqa: E402
from twinbill.streaming import intake  # noqa: E402
from twinbill.streaming.triage_stream import hot_blocks, triage_stream, write_matches  # noqa: E402

PARAMS = TriageParams()
PEPPER = oracle.PEPPER
PAIR = ["left_invoice_id", "right_invoice_id"]
LABELS = ("is_duplicate_record", "duplicate_type")

FIXED_MODEL = Model(
    mean=oracle.MEAN,
    scale=oracle.SCALE,
    coefficient=oracle.COEFFICIENT,
    intercept=oracle.INTERCEPT,
    threshold=oracle.THRESHOLD,
)


def entry(spark: SparkSession) -> DataFrame:
    """Train on the labelled ledger, then triage it."""
    return triage_trained(spark, "/root/testdata/sf0.001")


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names})


# --- ledgers and files ------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_ledger(spark, sf_dir)


def recurring_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_ledger(spark, sf_dir, recurring=True)


def injected_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        ledger(spark, sf_dir)
        .filter("is_duplicate_record")
        .groupBy("duplicate_type")
        .agg(F.count("*").alias("records"), F.sum("amount").alias("amount")),
        2,
        "amount",
    )


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    ledger(spark, sf_dir).drop(*LABELS).write.option("header", True).option(
        "emptyValue", ""
    ).csv(path)
    return V.typed(read_csv(spark, path))


def csv_quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the ledger's rows with a field too many and a tenth without the last one, among the others."""
    path = scratch_path(spark, "csv")
    rows = ledger(spark, sf_dir)
    number = F.substring("invoice_id", 3, 8).cast("bigint")
    amount = F.format_string("%.2f", "amount")
    fields = [amount if c == "amount" else F.col(c).cast("string") for c in INVOICE_COLUMNS]
    line = (
        F.when(number % 10 == 3, F.concat_ws(",", *fields[:-1]))
        .when(number % 10 == 7, F.concat_ws(",", *fields, F.lit("more")))
        .otherwise(F.concat_ws(",", *fields))
    )
    file = F.pmod(F.xxhash64("invoice_id"), F.lit(4))
    body = rows.select(file.alias("file"), F.lit(1).alias("after"), line.alias("line"))
    # each file starts with the header
    head = spark.range(4).select(F.col("id").alias("file"), F.lit(0).alias("after"), F.lit(",".join(INVOICE_COLUMNS)).alias("line"))
    lines = head.unionByName(body).repartition("file").sortWithinPartitions("file", "after")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return csv_quarantine(spark, f"{path}/*").drop("file")


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    invoice = F.struct(*[c for c in ledger(spark, sf_dir).columns if c not in ("group_id", *LABELS)])
    ledger(spark, sf_dir).select(F.array(invoice).alias("invoices")).write.json(path)
    rows = read_json_batches(spark, path, multiline=False)
    return V.typed(rows.drop("unknown_fields", "batch_id", "document", "problem"))


def _request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices of each vendor and quarter, in documents of at most about REQUEST_ROWS rows."""
    rows = ledger(spark, sf_dir).drop("group_id", *LABELS)
    amount = F.format_string("%.2f", "amount").alias("amount")
    invoice = F.struct(*[amount if c == "amount" else c for c in rows.columns])
    key = ["vendor_account_id", "quarter"]
    placed = rows.withColumn("quarter", F.date_trunc("quarter", "invoice_date"))
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / oracle.REQUEST_ROWS).alias("parts"))
    part = F.substring("invoice_id", 3, 8).cast("bigint") % F.col("parts")
    return (
        placed.join(sizes, key)
        .groupBy(*key, part.alias("part"))
        .agg(F.collect_list(invoice).alias("invoices"))
    )


def _triaged(spark: SparkSession, sf_dir: str, texts: DataFrame):
    path = scratch_path(spark, "requests")
    texts.write.option("compression", "gzip").text(path)
    return triage_requests(read_json_batches(spark, path, multiline=False), FIXED_MODEL, PARAMS, PEPPER)


def _requests(spark: SparkSession, sf_dir: str):
    """One document for the invoices of each vendor and quarter, triaged by document."""
    return _triaged(spark, sf_dir, _request_documents(spark, sf_dir).select(F.to_json(F.struct("invoices"))))


def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of documents of which some are cut off, sent twice, of the wrong form, empty or repeat an id."""
    made = _request_documents(spark, sf_dir).withColumn(
        "kind",
        (F.substring("vendor_account_id", 5, 4).cast("bigint") + F.year("quarter") * 4 + F.quarter("quarter")) % 8,
    )
    text, kind, rows = F.col("text"), F.col("kind"), F.col("invoices")
    doubled = F.when(kind == 5, F.concat(rows, F.slice(rows, 1, 1))).otherwise(rows)
    texts = made.withColumn("text", F.to_json(F.struct(doubled.alias("invoices")))).select(
        F.explode(
            F.when(kind == 0, F.array(F.left(text, F.length(text) - 20)))
            .when(kind == 1, F.array(text, text))
            .when(kind == 2, F.array(F.lit('{"invoices": "none"}')))
            .when(kind == 3, F.array(F.concat(F.lit('{"sender": 1, '), F.substr(text, F.lit(2)))))
            .when(kind == 4, F.array(F.lit('{"invoices": []}')))
            .otherwise(F.array(text))
        )
    )
    names = ["outcome", "reasons", "invoices", "reviewed_pairs", "flagged_pairs"]
    report = _triaged(spark, sf_dir, texts).documents.withColumn("reasons", F.array_join("reasons", ","))
    return report.groupBy(*names).agg(F.count("*").alias("documents"))


def request_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_requests(spark, sf_dir).matches).drop("batch_id")


def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have so many invoices, reviewed and flagged pairs."""
    names = ["invoices", "reviewed_pairs", "flagged_pairs"]
    return _requests(spark, sf_dir).summary.groupBy(*names).agg(F.count("*").alias("documents"))


# --- validation -------------------------------------------------------------


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as invoices, so the contract has something to reject."""
    text = F.col("text")
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("invoice_id"),
        F.col("source").alias("vendor_account_id"),
        text.alias("invoice_number"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
        .cast("string")
        .alias("invoice_date"),
        (F.col("n_chars") / 8).cast("decimal(20,3)").cast("string").alias("amount"),
        F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "X").otherwise("")).alias(
            "currency"
        ),
        F.col("lang").alias("po_number"),
        text.alias("bank_fingerprint"),
        text.alias("description"),
    )


def invoice_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.with_violations(_papers(spark, sf_dir))
    return checked.select("invoice_id", F.array_join("violations", ",").alias("violations"))


def invoice_contract_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.with_violations(ledger(spark, sf_dir).drop(*LABELS))
    return V.typed(V.accepted(checked), strict=True)


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = V.quarantined(V.with_violations(_papers(spark, sf_dir)))
    return (
        bad.select(F.explode("violations").alias("code"))
        .groupBy("code")
        .agg(F.count("*").alias("invoices"))
    )


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quality_profile(ledger(spark, sf_dir))


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invoices; some name a time or a day that does not exist."""
    event, moment = F.col("event_id").cast("string"), F.col("ts").cast("string")
    moment = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.left(moment, F.lit(10)), F.lit(" 25:61")))
        .when(F.col("event_id") % 11 == 0, F.concat(F.left(moment, F.lit(4)), F.lit("-02-30")))
        .otherwise(moment)
    )
    raw = read_table(spark, sf_dir, "events").select(
        event.alias("invoice_id"),
        F.col("user_id").cast("string").alias("vendor_account_id"),
        F.col("event_type").alias("invoice_number"),
        moment.alias("invoice_date"),
        F.col("value").cast("string").alias("amount"),
        F.lit("TRY").alias("currency"),
        F.lit("").alias("po_number"),
        F.col("user_id").cast("string").alias("bank_fingerprint"),
        F.col("props").alias("description"),
    )
    return V.check_profile(raw, labels=False)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return V.duplicate_ids(
        lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice_id"))
    )


def null_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    joined = documents.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(V.null_cells(joined).alias("null_cells"))


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.group_sizes(ledger(spark, sf_dir))


# --- text -------------------------------------------------------------------


def ascii_upper_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", ascii_upper(F.col("text")).alias("folded"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", normalize_identifier(F.col("text")).alias("normalized"))


def normalize_invoice_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select(
        "invoice_id", normalize_identifier(F.col("invoice_number")).alias("normalized")
    )


def digits_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", digit_signature(F.col("text")).alias("digits"))


def vendor_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select(
        "invoice_id", safe_reference(F.col("vendor_account_id"), PEPPER).alias("vendor_ref")
    )


# --- pairs ------------------------------------------------------------------


def _band(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = B.prepare(ledger(spark, sf_dir))
    return B.with_label(B.band_pairs(rows, max_days=PARAMS.max_date_gap_days, **options))


def vendor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir, blocks=("vendor",)).select(*PAIR)


def bank_only_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir, blocks=("bank",)).select(*PAIR)


def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir).select(*PAIR, "block", "label")


def _close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir, max_gap=PARAMS.max_amount_relative_gap)


def amount_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = amount_gap(F.col("left_amount"), F.col("right_amount"))
    return _close_pairs(spark, sf_dir).select(*PAIR, F.round(gap, 9).alias("gap"), "label")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candidate_pairs(ledger(spark, sf_dir), PARAMS)


def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("invoice_id", "vendor_account_id", "amount")
    return B.lookup_sides(candidate_pairs(spark, sf_dir).select(*PAIR), rows)


def _recall(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return _rounded(B.candidate_recall(rows, pairs), 9, "candidate_recall", "group_recall")


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    return _recall(rows, pair_features(rows, PARAMS))


def amount_gap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the amount branch alone, beside that of the whole rule."""
    return _recall(ledger(spark, sf_dir), _close_pairs(spark, sf_dir))


# --- features and scores ----------------------------------------------------


def native_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that need no text, on all pairs of the blocks."""
    rows = (
        _band(spark, sf_dir)
        .withColumns({**native_features(), "pair_type": pair_type(), "exposure": exposure()})
        .select(*PAIR, "label", "pair_type", "exposure", *native_features())
    )
    return _rounded(rows, 9, *native_features())


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_features(ledger(spark, sf_dir), PARAMS).drop("left_group_id")


def similarity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir), 9, *FEATURE_NAMES)


def description_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinbill.operators.features import with_features

    pairs = B.sided_pairs(ledger(spark, sf_dir), PARAMS, where=B.reachable(PARAMS))
    return (
        with_features(pairs, PARAMS)
        .groupBy("left_description_norm", "right_description_norm")
        .agg(
            F.count("*").alias("pairs"),
            F.round(F.max("description_similarity"), 9).alias("similarity"),
        )
    )


def exact_baseline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select(*PAIR, exact_baseline().alias("prediction"), "label")


def exact_key_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_key_pairs(ledger(spark, sf_dir), PARAMS).select(
        *PAIR, safe_reference(F.col("left_vendor_account_id"), PEPPER).alias("vendor_ref"), "label"
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_features(spark, sf_dir), FIXED_MODEL)


def predict_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir), 6, "probability").select(*PAIR, "probability")


def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _features(spark, sf_dir).select(
        *PAIR, F.posexplode(evidence(FIXED_MODEL)).alias("at", "item")
    )
    return items.select(
        *PAIR,
        (F.col("at") + 1).cast("bigint").alias("rank"),
        "item.feature",
        "item.value",
        "item.contribution",
    )


def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = decide(F.col("probability"), FIXED_MODEL.threshold)
    return _scored(spark, sf_dir).select(*PAIR, decision.alias("d")).select(*PAIR, "d.*")


def _flat(matches: DataFrame) -> DataFrame:
    """Matches with the four features of the evidence, strongest first, as text."""
    names = F.array_join(F.transform("evidence", lambda item: item["feature"]), ",")
    return matches.withColumn("evidence", names)


def triage_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their place as the result lies, and whether that is the place by the rule of the ranking."""
    matches = with_place(laid_out(triage(ledger(spark, sf_dir), FIXED_MODEL, PARAMS, PEPPER)))
    rule = (F.desc("risk_score"), F.asc("left_invoice_id"), F.asc("right_invoice_id"))
    placed = with_place(in_order(matches, *rule), "by_rule")
    return _flat(placed.withColumn("ranked", F.col("place") == F.col("by_rule")).drop("by_rule"))


def match_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written as JSON and read back."""
    path = scratch_path(spark, "sink")
    matches = flagged_pairs(ledger(spark, sf_dir), FIXED_MODEL, PARAMS, PEPPER)
    write_json(matches, path)
    return _flat(spark.read.schema(matches.schema).json(path))


def sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified sample written as CSV and read back."""
    path = scratch_path(spark, "sample")
    write_sample(S.stratified_sample(ledger(spark, sf_dir)), path)
    return V.typed(read_csv(spark, path)).drop("group_id").withColumn(
        "is_duplicate_record", F.col("is_duplicate_record").cast("boolean")
    )


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(ledger(spark, sf_dir), "ledger")
    return materialize(S.temporal_split(rows), "split")


def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed model with means and scales of the ledger's pairs, saved, verified and loaded."""
    path = scratch_path(spark, "model")
    mean, scale = LG.scaler(_features(spark, sf_dir))
    save_model(spark, replace(FIXED_MODEL, mean=tuple(mean), scale=tuple(scale)), path)
    return _rounded(parameter_rows(spark, load_model(spark, path)), 6, "mean", "scale")


def score_csv_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job: CSV files and a stored model in, JSON matches out."""
    source, model, output = (scratch_path(spark, name) for name in ("csv", "model", "scored"))
    rows = ledger(spark, sf_dir).drop(*LABELS)
    rows.write.option("header", True).option("emptyValue", "").option("compression", "gzip").csv(source)
    save_model(spark, FIXED_MODEL, model)
    score_csv(spark, source, model, output, PEPPER, PARAMS)
    # the output is read by the schema of matches, which needs no row
    none = spark.createDataFrame([], ledger(spark, sf_dir).schema)
    matches = flagged_pairs(none, FIXED_MODEL, PARAMS, PEPPER)
    return _flat(spark.read.schema(matches.schema).json(output))


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which invoice columns each table lacks, and which of its columns the contract does not know."""
    tables = {"ledger": ledger(spark, sf_dir)} | {
        name: read_table(spark, sf_dir, name) for name in ("orders", "documents", "events")
    }
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("source"),
            "rows",
            F.lit(V.missing_columns(df, labels=True)).cast("array<string>").alias("missing"),
            F.lit(V.unknown_columns(df)).cast("array<string>").alias("unknown"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select(
        "source", "rows", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown")
    )


def logistic_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss, gradient and Hessian sums of the fixed model over all candidate pairs."""
    parameters = np.array([*oracle.COEFFICIENT, oracle.INTERCEPT])
    pairs = _features(spark, sf_dir)
    parts = LG.objective_parts(pairs, parameters, oracle.MEAN, oracle.SCALE, oracle.CLASS_WEIGHTS)
    return parts.groupBy("place").agg(F.round(F.sum("part"), 3).alias("total"))


def trained_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the penalised loss at the fitted parameters: nothing is left of it."""
    rows = _split(spark, sf_dir)
    train = materialize(pair_features(rows.filter("split = 'train'"), PARAMS), "features")
    model = LG.fit(train)
    weights = LG.class_weights(train)
    parameters = np.array([*model.coefficient, model.intercept])
    parts = LG.objective_parts(train, parameters, model.mean, model.scale, weights)
    penalty = F.element_at(
        F.array(*[F.lit(float(p)) for p in parameters]), F.col("place").cast("int")
    )
    per_row = (F.col("total") + penalty) / train.count()
    return (
        parts.where(F.col("place").between(1, len(parameters)))
        .groupBy("place")
        .agg(F.sum("part").alias("total"))
        .select("place", F.abs(F.round(per_row, 6)).alias("gradient"))
    )


def compare_runs_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written twice and compared with itself, and with a run on another ledger."""
    folders = [scratch_path(spark, "run") for _ in range(3)]
    runs = [train_and_evaluate(labelled_ledger(spark, sf_dir, standing=again), PARAMS) for again in (False, True)]
    for folder, run in zip(folders, (runs[0], runs[0], runs[1]), strict=True):
        write_run(spark, run, folder)
    parts = [
        compare_runs(spark, folders[0], other).select(F.lit(name).alias("runs"), "item").distinct()
        for name, other in (("same", folders[1]), ("other", folders[2]))
    ]
    return parts[0].unionByName(parts[1])


def triage_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    model = train_and_evaluate(rows, PARAMS).model
    return triage(rows, model, PARAMS, PEPPER)


# --- split and sample -------------------------------------------------------


def group_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anchors(ledger(spark, sf_dir))


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.temporal_split(ledger(spark, sf_dir)).select("invoice_id", "group_id", "split")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_counts(S.temporal_split(ledger(spark, sf_dir)))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overlapping_groups(S.temporal_split(ledger(spark, sf_dir)))


def split_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    return X.pair_counts(pair_features(rows, PARAMS, within=("split",)))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = S.stratified_sample(ledger(spark, sf_dir))
    return sample.withColumn("position", F.col("position").cast("bigint"))


def ledger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in order, every row with its place."""
    return S.ledger_order(S.ledger_places(ledger(spark, sf_dir)))


# --- training and metrics ---------------------------------------------------


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = LG.statistics_table(_features(spark, sf_dir))
    return _rounded(stats, 6, "mean", "scale")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(LG.class_weight_table(_features(spark, sf_dir)), 9, "weight")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with the fixed model's prediction."""
    at_threshold = (F.col("probability") >= FIXED_MODEL.threshold).cast("int")
    return _scored(spark, sf_dir).withColumn("prediction", at_threshold)


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = LG.threshold_table(_judged(spark, sf_dir))
    return _rounded(table, 9, "precision", "recall", "f1")


def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = replace(FIXED_MODEL, intercept=oracle.STRICT_INTERCEPT)
    return LG.select_threshold(
        score(_features(spark, sf_dir), strict), PARAMS.min_validation_precision
    )


def threshold_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many thresholds satisfy each floor; none means that selection fails."""
    table = LG.threshold_table(_judged(spark, sf_dir))
    floors = F.explode(F.array(*[F.lit(floor) for floor in oracle.FLOORS])).alias("floor")
    return (
        table.select(floors, "precision")
        .groupBy("floor")
        .agg(F.count_if(F.col("precision") >= F.col("floor")).alias("thresholds"))
    )


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.confusion_matrix(_judged(spark, sf_dir))
    return _rounded(table, 9, "precision", "recall", "f1")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.average_precision(_judged(spark, sf_dir)), 6, "average_precision")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.roc_auc(_judged(spark, sf_dir)), 6, "roc_auc")


def _evaluated(scored: DataFrame) -> DataFrame:
    # both halves of the evaluation scan the written pairs
    table = X.evaluate(materialize(scored, "scored"))
    table = _rounded(table, 6, "average_precision", "roc_auc")
    return _rounded(table, 9, "precision", "recall", "f1")


def evaluate_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    at_threshold = (F.col("probability") >= FIXED_MODEL.threshold).cast("int")
    return _evaluated(scored.select("label", "probability", at_threshold.alias("prediction")))


def evaluate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = exact_baseline()
    return _evaluated(
        _features(spark, sf_dir).select(
            "label", rule.alias("prediction"), rule.cast("double").alias("probability")
        )
    )


def operational_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.operational_metrics(_judged(spark, sf_dir), PARAMS.false_positive_review_cost)
    table = _rounded(table, 9, "review_rate", "duplicate_value_capture")
    return _rounded(table, 2, "expected_control_cost")


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.recall_by_type(_judged(spark, sf_dir)), 9, "recall")


def report_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, pairs of the test split, fixed model and exact rule beside each other: ranking, rates and costs."""
    test = _split(spark, sf_dir).filter("split = 'test'")
    scored = materialize(score(pair_features(test, PARAMS, within=("split",)), FIXED_MODEL), "scored")
    at_threshold = (F.col("probability") >= FIXED_MODEL.threshold).cast("int")
    judges = {"model": (F.col("probability"), at_threshold), "baseline": (exact_baseline(), exact_baseline())}
    table = X.evaluate_judges(scored, judges, PARAMS.false_positive_review_cost)
    table = _rounded(table, 6, "average_precision", "roc_auc")
    table = _rounded(table, 9, "precision", "recall", "f1", "review_rate", "duplicate_value_capture")
    return _rounded(table, 2, "expected_control_cost")


def train_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters fitted on the training split, stored and loaded back."""
    rows = _split(spark, sf_dir)
    pairs = pair_features(rows.filter("split = 'train'"), PARAMS)
    path = scratch_path(spark, "model")
    save_model(spark, LG.fit(materialize(pairs, "features")), path)
    return parameter_rows(spark, load_model(spark, path))


def train_model_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    pairs = pair_features(rows.filter("split = 'train'"), PARAMS)
    return parameter_rows(spark, LG.fit(materialize(pairs, "features"), solver="mllib"))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = train_and_evaluate(recurring_ledger(spark, sf_dir), PARAMS)
    write_run(spark, run, scratch_path(spark, "run"))
    return run.evaluation_table(spark)


# --- run comparison ---------------------------------------------------------


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = differences(ledger(spark, sf_dir), recurring_ledger(spark, sf_dir), ["invoice_id"])
    return found.select("invoice_id", "column")


def unequal_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unequal_rows(ledger(spark, sf_dir), recurring_ledger(spark, sf_dir))
    return found.groupBy("side").agg(F.count("*").alias("records"))


# --- streaming --------------------------------------------------------------


# Files of one batch of a stream at least, rows that a file of a large one should hold, and the first day of every
# batch but the first.
ARRIVAL_FILES = 4
ARRIVAL_ROWS = 500_000
ARRIVAL_DAYS = ("1997-01-01", "1999-01-01", "2000-07-01")


def _arrival_files(sizes: list[int]) -> int:
    """Files of each batch: enough for the largest batch, and none without rows in the smallest."""
    return max(ARRIVAL_FILES, min(max(sizes) // ARRIVAL_ROWS, min(sizes) // 1000))


def _arrive(spark: SparkSession, rows: DataFrame, batch: Column) -> DataFrame:
    """``rows`` as a stream: one micro-batch for each value 0, 1, ... of ``batch``, in that order."""
    folder = scratch_path(spark, "arrivals")
    # written once: the batches are parts of one table
    placed = materialize(rows.withColumn("_arrival", batch), "arriving", by=("_arrival",))
    sizes = {r["_arrival"]: r["count"] for r in placed.groupBy("_arrival").count().collect()}
    batches = range(len(ARRIVAL_DAYS) + 1)
    files = _arrival_files([sizes.get(number, 0) for number in batches])
    for number in batches:
        part = placed.where(F.col("_arrival") == number).drop("_arrival").repartition(files)
        part.write.mode("append").parquet(folder)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def _batch_of(day: Column) -> Column:
    return sum(((day >= start).cast("int") for start in ARRIVAL_DAYS), F.lit(0))


def triage_stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive as a stream; matches are appended to a table."""
    table = read_table(spark, sf_dir, "orders")
    orders = _arrive(spark, table, _batch_of(F.col("o_orderdate").cast("date")))
    arriving = inject(
        base_ledger(
            orders, read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
        )
    )
    output = scratch_path(spark, "matches")
    # copies are dated up to three weeks after the order they arrive with
    hot = hot_blocks(ledger(spark, sf_dir))
    matches = triage_stream(arriving, FIXED_MODEL, PARAMS, PEPPER, lateness="30 days", hot=hot)
    query = write_matches(matches, output, scratch_path(spark, "stream"))
    query.awaitTermination()
    return _flat(spark.read.schema(matches.schema).parquet(output))


def _arriving_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a stream of texts: some rows come years late, some twice, some break the contract."""
    rows = ledger(spark, sf_dir).drop("group_id", *LABELS)
    number, day = F.substring("invoice_id", 3, 8).cast("bigint"), F.col("invoice_date")
    batch = F.when(number % 13 == 0, len(ARRIVAL_DAYS)).otherwise(_batch_of(day))
    changed = {
        "amount": F.when(number % 29 == 0, "0.00").otherwise(F.format_string("%.2f", "amount")),
        "currency": F.when(number % 23 == 0, F.lower("currency")).otherwise(F.col("currency")),
    }
    texts = rows.withColumns(
        {c: changed.get(c, F.col(c).cast("string")) for c in rows.columns}
        | {"batch": batch, "copy": F.explode(F.sequence(F.lit(0), (number % 17 == 0).cast("int")))}
    )
    return _arrive(spark, texts, F.col("batch")).drop("batch", "copy")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each batch of a stream read, accepted, found late and found repeated."""
    good = intake.accepted(_arriving_texts(spark, sf_dir), "30 days")
    query = intake.append(good, scratch_path(spark, "accepted"), scratch_path(spark, "stream"))
    query.awaitTermination()
    return intake.arrivals(query)


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ids that a stream sets aside, read back from the quarantine table."""
    bad = intake.quarantine(_arriving_texts(spark, sf_dir), "30 days")
    output = scratch_path(spark, "quarantine")
    intake.append(bad, output, scratch_path(spark, "stream")).awaitTermination()
    found = spark.read.schema(bad.schema).parquet(output)
    return found.withColumn("reasons", F.array_join("reasons", ","))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ledger": ledger,
    "recurring_ledger": recurring_ledger,
    "csv_source": csv_source,
    "csv_quarantine": csv_quarantine_rows,
    "json_source": json_source,
    "injected_duplicates": injected_duplicates,
    "invoice_contract_violations": invoice_contract_violations,
    "invoice_contract_accepted": invoice_contract_accepted,
    "violation_counts": violation_counts,
    "quality_profile": quality_profile,
    "table_checks": table_checks,
    "duplicate_ids": duplicate_ids,
    "null_cells": null_cells,
    "group_sizes": group_sizes,
    "ascii_upper": ascii_upper_documents,
    "normalize_identifier": normalize_documents,
    "normalize_invoice_number": normalize_invoice_number,
    "digit_signature": digits_of_documents,
    "safe_reference": vendor_references,
    "vendor_pairs": vendor_pairs,
    "bank_only_pairs": bank_only_pairs,
    "blocked_pairs": blocked_pairs,
    "amount_gap_pairs": amount_gap_pairs,
    "candidate_pairs": candidate_pairs,
    "pair_lookup": pair_lookup,
    "candidate_recall": candidate_recall,
    "amount_gap_recall": amount_gap_recall,
    "native_pair_features": native_pair_features,
    "similarity_features": similarity_features,
    "description_similarity": description_similarity,
    "exact_baseline": exact_baseline_pairs,
    "exact_key_hold": exact_key_hold,
    "predict_fixed_model": predict_fixed_model,
    "feature_contributions": feature_contributions,
    "policy_decision": policy_decision,
    "triage_fixed_model": triage_fixed_model,
    "triage": triage_trained,
    "group_anchors": group_anchors,
    "temporal_split": temporal_split,
    "split_counts": split_counts,
    "split_overlap": split_overlap,
    "split_candidate_pairs": split_candidate_pairs,
    "stratified_sample": stratified_sample,
    "ledger_order": ledger_order,
    "feature_statistics": feature_statistics,
    "class_weights": class_weights,
    "threshold_table": threshold_table,
    "threshold_select": threshold_select,
    "confusion_matrix": confusion_matrix,
    "average_precision": average_precision,
    "roc_auc": roc_auc,
    "evaluate_fixed_model": evaluate_fixed_model,
    "evaluate_baseline": evaluate_baseline,
    "operational_metrics": operational_metrics,
    "recall_by_type": recall_by_type,
    "report_fixed_model": report_fixed_model,
    "train_model": train_model,
    "train_model_mllib": train_model_mllib,
    "evaluation_report": evaluation_report,
    "run_compare": run_compare,
    "unequal_rows": unequal_row_counts,
    "triage_stream": triage_stream_matches,
    "stream_late_rows": stream_late_rows,
    "stream_quarantine": stream_quarantine,
    "threshold_floors": threshold_floors,
    "request_matches": request_matches,
    "request_summary": request_summary,
    "request_documents": request_documents,
    "match_sink": match_sink,
    "sample_sink": sample_sink,
    "model_store": model_store,
    "score_csv": score_csv_job,
    "required_columns": required_columns,
    "logistic_sums": logistic_sums,
    "trained_gradient": trained_gradient,
    "compare_runs": compare_runs_job,
}


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the optional subpackage; nothing if it is not there."""
    try:
        from twinbill.llm import queries as llm
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith("twinbill.llm"):
            raise
        return {}, {}
    except ImportError as missing:
        if missing.name != "twinbill.llm":
            raise
        return {}, {}
    found, sql = llm.queries(), llm.oracle_sql()
    try:
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise
    else:
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return dict(_QUERIES) | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    """SQL twins; iterative training and its consumers have none."""
    return dict(oracle.ORACLES) | _training_data()[1]
