"""Streaming: the live state of an allocation trace (SRC12), and a batch form of the same fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.sources.text import fold_trace, trace_events


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream of lines."""
    return spark.readStream.text(path).select(F.col("value").alias("line"))


def live_objects(lines: DataFrame) -> DataFrame:
    """Net count and state of each (cache, address); in update mode each batch emits what changed."""
    return fold_trace(trace_events(lines), ["cache", "address"], "delta")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind, with late data dropped after the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def run_to_table(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Process what is available and return the sink's table (tests and one-off runs)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
