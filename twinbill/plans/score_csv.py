"""Batch scoring of a CSV file; run with spark-submit.

    spark-submit score_csv.py INVOICES MODEL OUTPUT [PEPPER]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from twinbill.params import TriageParams
from twinbill.plans.triage import triage
from twinbill.sources.files import read_csv, write_json
from twinbill.sources.model_store import load_model

# Fixed value: pseudonym pepper of demonstrations.
DEMO_PEPPER = "demo-only-pepper"


def score_csv(
    spark: SparkSession,
    csv_path: str,
    model_path: str,
    output_path: str,
    pepper: str = DEMO_PEPPER,
    params: TriageParams = TriageParams(),
) -> None:
    model = load_model(spark, model_path)
    write_json(triage(read_csv(spark, csv_path), model, params, pepper), output_path)


if __name__ == "__main__":
    score_csv(SparkSession.builder.appName("score-invoices").getOrCreate(), *sys.argv[1:5])
