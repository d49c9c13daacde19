"""Classification, ranking and cost metrics as aggregates.

Inputs carry ``label`` (0/1) and, as needed, ``prediction`` (0/1),
``probability`` and ``exposure``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinbill.session import materialize

#: A block of scores: its range partition, the pairs above it, its own, the number of scores and the counts of each.
BLOCK_SCHEMA = "part int, pos_above bigint, neg_above bigint, pos bigint, neg bigint, scores bigint, counts binary"


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _is(label: int, prediction: int) -> Column:
    return (F.col("label") == label) & (F.col("prediction") == prediction)


def confusion_counts() -> list[Column]:
    return [
        F.count_if(_is(0, 0)).alias("tn"),
        F.count_if(_is(0, 1)).alias("fp"),
        F.count_if(_is(1, 0)).alias("fn"),
        F.count_if(_is(1, 1)).alias("tp"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 beside the confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return with_rates(scored.agg(*confusion_counts()))


def operational(review_cost: float) -> list[Column]:
    """Review rate, captured share of duplicate value, expected control cost."""
    stake = F.col("exposure")
    at_stake = F.sum(F.when(F.col("label") == 1, stake))
    captured = F.sum(F.when(_is(1, 1), stake))
    missed = F.coalesce(F.sum(F.when(_is(1, 0), stake)), F.lit(0.0))
    return [
        F.avg("prediction").alias("review_rate"),
        F.when(F.coalesce(at_stake, F.lit(0.0)) == 0, 1.0)
        .otherwise(F.coalesce(captured, F.lit(0.0)) / at_stake)
        .alias("duplicate_value_capture"),
        (missed + F.count_if(_is(0, 1)) * F.lit(review_cost)).alias("expected_control_cost"),
    ]


def operational_metrics(scored: DataFrame, review_cost: float = 50.0) -> DataFrame:
    return scored.agg(*operational(review_cost))


def recall_by_type(scored: DataFrame) -> DataFrame:
    """Recall and support of the positive pairs per duplicate type."""
    return (
        scored.filter("label = 1")
        .groupBy(F.col("pair_type").alias("duplicate_type"))
        .agg(F.avg("prediction").alias("recall"), F.count("*").alias("support"))
        .orderBy("duplicate_type")
    )


def score_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Positive and negative pairs per score of each Arrow batch, written once.

    A score that very many pairs share comes as one row a batch, so the range
    partition it goes to stays small.
    """
    rows = scored.select(
        *by,
        F.col("probability").cast("double"),
        *[F.coalesce(F.col("label") == y, F.lit(False)).cast("bigint").alias(name) for y, name in ((1, "pos"), (0, "neg"))],
    )

    def counts(batches):
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by([*by, "probability"], use_threads=False)
            summed = sums.aggregate([("pos", "sum"), ("neg", "sum")])
            names = [*by, "probability", "pos_sum", "neg_sum"]
            yield from summed.select(names).rename_columns(batch.schema.names).to_batches()

    return materialize(rows.mapInArrow(counts, rows.schema), "scores")


def _ties(rows: pa.Table, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted rows another score begins, and where another group (of ``by``) does."""
    other = np.zeros(rows.num_rows, bool)
    other[:1] = True
    for name in by:
        codes = rows.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        other[1:] |= codes[1:] != codes[:-1]
    score = rows.column("probability")
    value, known = score.to_numpy(), np.asarray(score.is_valid())
    unlike = (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
    changed = other.copy()
    changed[1:] |= unlike | (known[1:] != known[:-1])
    return np.flatnonzero(changed), other


def running_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Blocks of distinct scores (of each ``by``), highest first: the counts of each score in the block, and the positive
    and negative pairs above the block.

    Scores are dealt to range partitions; what lies above a block is counted in its partition, and known for
    the partitions before from one sum for each.
    """
    order = [*[F.asc(name) for name in by], F.desc("probability")]
    dealt = score_counts(scored, *by).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*dealt.select(*by).schema, *T.StructType.fromDDL(BLOCK_SCHEMA)])
    own_fields = [*[(name, pa.int64()) for name in schema.names[len(by) + 1 : -1]], ("counts", pa.binary())]

    def blocks(batches):
        part, above, held = TaskContext.get().partitionId(), (0, 0), None

        def cut(rows, firsts, counts, group):
            nonlocal above
            # a block holds scores of one group
            bounds = [0, *[k for k in range(1, len(firsts)) if group[firsts[k]]], len(firsts)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if group[firsts[start]]:
                    above = (0, 0)
                own = counts[:, start:end]
                own = own.astype(np.min_scalar_type(int(own.max())))
                sums = [int(n) for n in own.sum(axis=1, dtype=np.int64)]
                fields = [*[rows.schema.field(name) for name in by], ("part", pa.int32()), *own_fields]
                values = [rows.column(name)[firsts[start]].as_py() for name in by]
                row = [*values, part, *above, *sums, own.shape[1], own.tobytes()]
                above = (above[0] + sums[0], above[1] + sums[1])
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], pa.schema(fields))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch])
            firsts, group = _ties(rows, by)
            if held is not None:
                group[0] = fresh
            counts = np.add.reduceat(np.stack([rows.column(c).to_numpy() for c in ("pos", "neg")]), firsts, axis=1)
            yield from cut(rows, firsts[:-1], counts[:, :-1], group)
            # the last score may go on in the next batch
            fresh = bool(group[firsts[-1]])
            last = rows.slice(int(firsts[-1]), 1).combine_chunks().to_batches()[0]
            arrays = [last.column(c) for c in (*by, "probability")] + [pa.array([int(n)]) for n in counts[:, -1]]
            held = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        if held is not None:
            counts = np.array([[held.column(c)[0].as_py()] for c in ("pos", "neg")])
            yield from cut(pa.Table.from_batches([held]), np.array([0]), counts, np.array([fresh]))

    table = materialize(dealt.mapInArrow(blocks, schema), "ranges")
    totals = table.groupBy(*by, "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in ("pos", "neg")]
    # as long as there are partitions
    return (
        table.join(F.broadcast(totals.select(*by, "part", *carried)), [*by, "part"])
        .withColumns({f"{k}_above": F.col(f"{k}_above") + F.col(f"{k}_before") for k in ("pos", "neg")})
        .drop("part", "pos_before", "neg_before")
    )


def ranking_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Step-wise average precision and ROC area (of each ``by``), tied scores taken together."""
    blocks = running_counts(scored, *by)
    parts = "pos bigint, neg bigint, steps double, misordered double"
    schema = T.StructType([*blocks.select(*by).schema, *T.StructType.fromDDL(parts)])
    own_fields = [("pos", pa.int64()), ("neg", pa.int64()), ("steps", pa.float64()), ("misordered", pa.float64())]

    def sums(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                counts, n = row["counts"], row["scores"]
                pos, neg = np.frombuffer(counts, f"u{len(counts) // (2 * n)}").reshape(2, n).astype(np.float64)
                cum_pos, cum_neg = row["pos_above"] + np.cumsum(pos), row["neg_above"] + np.cumsum(neg)
                steps = pos * (cum_pos / np.maximum(cum_pos + cum_neg, 1.0))
                # negatives below a score = all negatives minus those at or above it
                misordered = pos * (cum_neg - neg / 2)
                cells = [row["pos"], row["neg"], float(steps.sum()), float(misordered.sum())]
                found.append(dict(zip(schema.names, [*[row[name] for name in by], *cells], strict=True)))
            fields = [*[batch.schema.field(name) for name in by], *own_fields]
            yield pa.RecordBatch.from_pylist(found, pa.schema(fields))

    sums_of = blocks.mapInArrow(sums, schema).groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum("steps").alias("steps"),
        F.sum("misordered").alias("misordered"),
    )
    p, n = F.col("p"), F.col("n")
    return sums_of.select(
        *by,
        F.when(p > 0, F.col("steps") / p).otherwise(0.0).alias("average_precision"),
        F.when((p > 0) & (n > 0), 1 - F.col("misordered") / (p * n)).alias("roc_auc"),
    )


def average_precision(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("average_precision")


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("roc_auc")


def evaluate(scored: DataFrame) -> DataFrame:
    """Ranking metrics, rates and confusion counts in one row."""
    return _beside(ranking_metrics(scored), confusion_matrix(scored))


def evaluate_judges(scored: DataFrame, judges: dict[str, tuple[Column, Column]], review_cost: float) -> DataFrame:
    """Ranking metrics, rates, confusion counts and costs of several judges of the same pairs, one row for each.

    ``judges`` names the (probability, prediction) of each. All of them share one
    pass for counts and costs and one for the ranking.
    """
    verdicts = F.array(
        *[
            F.struct(F.lit(name).alias("judge"), score.cast("double").alias("probability"), call.alias("prediction"))
            for name, (score, call) in judges.items()
        ]
    )
    judged = scored.select("label", "exposure", F.inline(verdicts))
    names = ["review_rate", "duplicate_value_capture", "expected_control_cost"]
    costs = [column.alias(name) for name, column in zip(names, operational(review_cost), strict=True)]
    counts = with_rates(judged.groupBy("judge").agg(*confusion_counts(), *costs))
    return counts.join(ranking_metrics(judged, "judge"), "judge")


def _beside(*rows: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row."""
    names = [c for row in rows for c in row.columns]
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def split_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if("is_duplicate_record").alias("duplicate_records"),
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("label") == 1).alias("positive_pairs"),
        F.count_if(F.col("label") == 0).alias("negative_pairs"),
    )
