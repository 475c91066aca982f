"""Trends while deliveries arrive: an extension, the graph tables read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_rates(edges: DataFrame, window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """window_start, kind, edges: scanned edges per event-time window; rows later than ``lateness`` are dropped by
    the watermark in a stream, and all count in a batch. Null times belong to no window."""
    rows = edges.where("scanned_at is not null").select(F.col("scanned_at").cast("timestamp").alias("scanned_at"), F.lower(F.trim("kind")).alias("kind"))
    counted = rows.withWatermark("scanned_at", lateness).groupBy(F.window("scanned_at", window), "kind").agg(F.count(F.lit(1)).alias("edges"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "edges")


def start(edges: DataFrame, path: str, checkpoint: str, window: str = "1 day", lateness: str = "30 days"):
    """Runs edge_rates over a streaming ``edges`` into parquet; the checkpoint folder makes restarts exact."""
    return (
        edge_rates(edges, window, lateness).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
