"""Structured Streaming counterparts of the event operators (an extension; not one of the surveyed operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key; works on a stream (with its watermark) and on a table alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant, not a local time
    source = events.withWatermark(time, late) if events.isStreaming else events
    counts = source.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").alias("start"), key, "n", "total")


def to_memory(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete"):
    """Run a stream over what is available into an in-memory table, for tests."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)
