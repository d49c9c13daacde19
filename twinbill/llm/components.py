"""Connected components over an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _stars(edges: DataFrame, keep: str) -> DataFrame:
    """Connect every neighbour that ``keep`` admits to the smallest neighbour of the vertex."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    least = least.select("u", F.least("u", "low").alias("low"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs to ``(id, component)`` for all ids with a link.

    The component is the smallest id that can be reached. Every step is a
    grouping and a join whose skewed keys Spark may split; each vertex keeps
    one row, so a hub never becomes a list. Self links and repeats are
    allowed, null ends are ignored, an empty table gives an empty result.
    """
    edges = edges.where("u is not null and v is not null and u <> v").distinct()
    seen = None
    while True:
        large = _stars(_both_ways(edges), "v > u").where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _stars(down, "v <= u").unionByName(
            down.groupBy("u").agg(F.min("v").alias("v"))
        )
        edges = materialize(
            small.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(),
            "links",
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
