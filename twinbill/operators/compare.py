"""Differences between two tables of two runs.

Rows are dealt to buckets by a hash of their key, and each bucket has a fingerprint
that does not depend on order: the number of rows and sums of two hashes of the whole
row. Only rows of buckets whose fingerprints differ are joined; equal tables are
compared by one aggregate each. Two unequal buckets look equal about once in 2^96 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinbill.session import materialize

# Tolerances for floating-point columns.
RELATIVE = 1e-9
ABSOLUTE = 1e-12


# Buckets of a table: few enough for their fingerprints to collapse on the map side.
BUCKETS = 1 << 16


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{key}`") for key in keys]), F.lit(BUCKETS))


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, rows, wide, narrow) of a table, by a hash of ``keys``."""
    whole = [F.col(f"`{name}`") for name in sorted(df.columns)]
    return df.groupBy(_bucket(keys).alias("bucket")).agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*whole).cast("decimal(38,0)")).alias("wide"),
        F.sum(F.hash(*whole).cast("bigint")).alias("narrow"),
    )


def suspects(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that lie in buckets with unequal fingerprints."""
    names = ["rows", "wide", "narrow"]
    sides = [fingerprints(df, keys) for df in (reference, candidate)]
    signed = [side.select("bucket", *names, F.lit(k).alias("side")) for k, side in enumerate(sides)]
    alone = (F.count("*") == 1).alias("alone")
    unlike = [(F.min(name) != F.max(name)).alias(name) for name in names]
    unequal = materialize(
        signed[0]
        .unionByName(signed[1])
        .groupBy("bucket")
        .agg(alone, *unlike)
        .where("alone or rows or wide or narrow")
        .select("bucket"),
        "unequal",
    )
    return tuple(
        df.withColumn("_bucket", _bucket(keys))
        .join(unequal.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi")
        .drop("_bucket")
        for df in (reference, candidate)
    )


def close(reference: Column, candidate: Column) -> Column:
    return F.abs(reference - candidate) <= ABSOLUTE + RELATIVE * F.abs(candidate)


def differences(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and column that differs; floats within tolerance agree.

    A row missing on one side differs in every column.
    """
    if set(reference.columns) == set(candidate.columns):
        reference, candidate = suspects(reference, candidate, keys)
    r, c = reference.alias("r"), candidate.alias("c")
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}"))
    here, there = F.col("r.present"), F.col("c.present")
    joined = r.withColumn("present", F.lit(True)).alias("r").join(
        c.withColumn("present", F.lit(True)).alias("c"), same_key, "full_outer"
    )
    checks = []
    for field in reference.schema:
        if field.name in keys:
            continue
        a, b = F.col(f"r.{field.name}"), F.col(f"c.{field.name}")
        equal = a.eqNullSafe(b)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            equal = equal | F.coalesce(close(a, b), F.lit(False))
        equal = equal & here.isNotNull() & there.isNotNull()
        checks.append(
            F.when(
                ~equal,
                F.struct(
                    F.lit(field.name).alias("column"),
                    a.cast("string").alias("reference_value"),
                    b.cast("string").alias("candidate_value"),
                ),
            )
        )
    return joined.select(
        *[F.coalesce(F.col(f"r.{key}"), F.col(f"c.{key}")).alias(key) for key in keys],
        F.inline(F.filter(F.array(*checks), lambda item: item.isNotNull())),
    )


def unequal_rows(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one of two tables holds.

    Both tables are written first, as two passes read them. Equal rows of both sides meet in
    one aggregate, which tells how many more one side has.
    """
    names = sorted(reference.columns)
    sides = [materialize(df.select(*names), "side") for df in (reference, candidate)]
    left, right = (
        df.withColumn("surplus", F.lit(sign)) for sign, df in zip((1, -1), suspects(*sides, names), strict=True)
    )
    counted = left.unionByName(right).groupBy(*names).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")
    copies = F.sequence(F.lit(1).cast("bigint"), F.abs("surplus"))
    side = F.when(F.col("surplus") > 0, "reference").otherwise("candidate").alias("side")
    return counted.select(*names, side, F.explode(copies).alias("copy")).drop("copy")
