"""Tables written between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path  # noqa: F401


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{name}`") for name in names])
