"""Are two training runs the same, apart from the artifact digest?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinbill.operators.compare import differences, unequal_rows
from twinbill.plans.training import EVALUATION_SCHEMA, QUALITY_SCHEMA
from twinbill.sources.files import read_csv
from twinbill.sources.model_store import load_model, parameter_rows


def _entries(name: str) -> Column:
    """The entries of a map as metrics; no map has none."""
    prefix = F.lit(f"{name}.")
    entries = F.transform(
        F.map_entries(name),
        lambda e: F.struct(
            F.concat(prefix, e["key"]).alias("metric"),
            F.lit(None).cast("string").alias("text"),
            e["value"].cast("double").alias("number"),
        ),
    )
    return F.coalesce(entries, F.array().cast("array<struct<metric:string,text:string,number:double>>"))


def tall(report: DataFrame) -> DataFrame:
    """A report of one row as (metric, text, number), one row per scalar.

    Entries of structs and maps are metrics of their own; numbers stay numbers,
    so that two runs may differ by the order in which floats were added up.
    """
    cells = []

    def add(name: Column, value: Column, kind: T.DataType) -> None:
        number = isinstance(kind, T.NumericType)
        cells.append(
            F.array(
                F.struct(
                    name.alias("metric"),
                    F.lit(None).cast("string").alias("text") if number else value.cast("string").alias("text"),
                    (value.cast("double") if number else F.lit(None).cast("double")).alias("number"),
                )
            )
        )

    for field in report.schema:
        kind, own = field.dataType, F.col(field.name)
        if isinstance(kind, T.StructType):
            for part in kind:
                add(F.lit(f"{field.name}.{part.name}"), own[part.name], part.dataType)
        elif isinstance(kind, T.MapType):
            cells.append(_entries(field.name))
        else:
            add(F.lit(field.name), own, kind)
    return report.select(F.inline(F.concat(*cells)))


def compare_runs(spark: SparkSession, reference: str, candidate: str) -> DataFrame:
    """(item, detail) of every difference; empty when the runs agree.

    Both models are verified first. Parameters and numbers of the reports agree
    within tolerance, names, threshold, texts and sample exactly.
    """
    models = [load_model(spark, f"{run}/model") for run in (reference, candidate)]

    def parameters(model) -> DataFrame:
        rest = [(len(model.mean), "intercept", 0.0, 1.0, model.intercept)]
        rows = parameter_rows(spark, model)
        return rows.unionByName(spark.createDataFrame(rest, rows.schema))

    def manifest(model) -> DataFrame:
        fixed = (list(model.feature_names), model.threshold, model.synthetic_training_data)
        return spark.createDataFrame(
            [fixed],
            "feature_names array<string>, threshold double, synthetic_training_data boolean",
        )

    def report(run: str, name: str, schema: str) -> DataFrame:
        return tall(spark.read.schema(schema).json(f"{run}/{name}").drop("artifact_sha256"))

    def detail(item: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(item).alias("item"), F.to_json(F.struct("*")).alias("detail"))

    def pair(read) -> list[DataFrame]:
        return [read(run) for run in (reference, candidate)]

    found = [
        detail("parameters", differences(*map(parameters, models), ["position", "feature"])),
        detail("manifest", unequal_rows(*map(manifest, models))),
        detail(
            "evaluation",
            differences(*pair(lambda run: report(run, "evaluation", EVALUATION_SCHEMA)), ["metric"]),
        ),
        detail(
            "data_quality",
            differences(*pair(lambda run: report(run, "data_quality", QUALITY_SCHEMA)), ["metric"]),
        ),
        detail("sample", unequal_rows(*pair(lambda run: read_csv(spark, f"{run}/sample")))),
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def assert_same_run(spark: SparkSession, reference: str, candidate: str) -> None:
    items = [r["item"] for r in compare_runs(spark, reference, candidate).select("item").distinct().collect()]
    if items:
        raise AssertionError(f"runs differ in: {sorted(items)}")
