"""Structured Streaming over events and graphs. Beyond the batch operators: windows with late data, and continuous sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; works on a stream and on a table."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) by sessions without a gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events once each by event_id, state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sync_stream(changes: DataFrame, store, checkpoint: str):
    """A stream of quads into a store: each batch replaces the graphs that it holds. Returns the writer; callers start it."""

    def put(batch: DataFrame, _: int) -> None:
        from graphloom.sources.quads import union

        touched = batch.select("g").distinct()
        store.change(added=batch, removed=store.quads.join(touched, "g", "left_semi"))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
