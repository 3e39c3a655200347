"""Redaction of a stream: row by row in append mode, and audit counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.plans.redact import redact, redact_rows
from textguard.schema import Settings


def redact_stream(units: DataFrame, settings: Settings) -> DataFrame:
    """A streaming (or static) frame with redacted_text and events; stateless."""
    return redact_rows(units, settings)


def audit_windows(redacted: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Redactions by category and tumbling window; state is dropped once the watermark passes."""
    events = redacted.select(ts, F.explode("events.category").alias("category")).withWatermark(ts, late)
    counts = events.groupBy(F.window(ts, window), "category").agg(F.count(F.lit(1)).alias("redactions"))
    return counts.select(F.col("window.start").alias("window_start"), "category", "redactions")


def redact_batches(units: DataFrame, settings: Settings, sink, checkpoint: str):
    """Whole documents per micro-batch, names included: ``sink(redaction, batch_id)`` gets each and must have read it when it returns."""

    def handle(batch: DataFrame, number: int) -> None:
        run = redact(batch, settings)
        sink(run, number)
        run.close()

    return units.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).start()
