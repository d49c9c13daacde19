"""Checks on invoices as they arrive: row contract, unique ids, late rows.

Three results come from one stream of untyped invoices. ``accepted`` are typed
rows that keep the contract, each id once within the lateness; ``quarantine`` are
rows that break it and ids that came more than once; ``arrivals`` reads from the
progress of the accepting query how many rows each batch took in and how many of
them came too late or repeated an id. State is kept on disk by Spark's own operators and
leaves with the watermark, so it is bounded by the invoices of the lateness.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinbill.operators import validate as V
from twinbill.streaming.state import state_on_disk

REPEATED = "invoice_id_repeated"
ARRIVAL_SCHEMA = "batch bigint, rows_read bigint, accepted bigint, late bigint, repeated bigint"


def _kept(invoices: DataFrame, lateness: str) -> DataFrame:
    """Rows that keep the contract, typed, with their date as event time."""
    typed = V.typed(V.accepted(V.with_violations(invoices)), strict=True)
    return typed.withColumn("invoice_ts", F.col("invoice_date").cast("timestamp")).withWatermark(
        "invoice_ts", lateness
    )


def accepted(invoices: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Typed rows that keep the contract, the first of each id.

    A row dated further behind the newest one than ``lateness`` is late and
    left out. An id is remembered until the watermark has passed its date by
    the lateness.
    """
    return _kept(invoices, lateness).dropDuplicatesWithinWatermark(["invoice_id"]).drop("invoice_ts")


def quarantine(invoices: DataFrame, lateness: str = "7 days") -> DataFrame:
    """``invoice_id, reasons, copies``: rows that break the contract, at once, and ids with more than one copy.

    Copies of an id whose dates lie less than the lateness apart make one
    session; it comes out when the watermark has passed it. Copies are in none if
    their whole session lies behind the watermark as they come.
    """
    broken = V.quarantined(V.with_violations(invoices)).select(
        "invoice_id", F.col("violations").alias("reasons"), F.lit(1).cast("bigint").alias("copies")
    )
    sessions = (
        _kept(invoices, lateness)
        .groupBy("invoice_id", F.session_window("invoice_ts", lateness))
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )
    repeated = sessions.select("invoice_id", F.array(F.lit(REPEATED)).alias("reasons"), "copies")
    return broken.unionByName(repeated)


def append(rows: DataFrame, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append rows of a stream to a parquet table; each is written exactly once.

    The ids of the lateness may outgrow the heap, so the query keeps its state on disk; the
    session's own setting for other queries stays as it is.
    """
    with state_on_disk(rows.sparkSession):
        return (
            rows.writeStream.format("parquet")
            .outputMode("append")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def _arrival(progress: dict[str, Any]) -> tuple[int, int, int, int, int]:
    """Batch and its counts, from the progress of the query that writes ``accepted``."""
    (state,) = progress["stateOperators"]
    late = state["numRowsDroppedByWatermark"]
    repeated = state["customMetrics"].get("numDroppedDuplicateRows", 0)
    # what the operator takes into its state is what goes on
    return progress["batchId"], progress["numInputRows"], state["numRowsUpdated"], late, repeated


def arrivals(query: StreamingQuery) -> DataFrame:
    """Rows read, accepted, late and repeated of each batch of the query that writes ``accepted``.

    Spark calls a row late that lies behind the watermark which the batch before
    began with. It keeps the progress of the last
    ``spark.sql.streaming.numRecentProgressUpdates`` batches; a query that runs
    on is read more often than that.
    """
    rows = [_arrival(p) for p in query.recentProgress if p["numInputRows"]]
    return SparkSession.active().createDataFrame(rows, ARRIVAL_SCHEMA)
