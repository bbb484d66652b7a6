"""Structured Streaming over event files: windows with watermarks, and an index that
follows arriving files. The batch forms give the same rows over a finished table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", watermark: str | None = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) for windows that do not overlap."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", watermark: str | None = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): bursts of a user's events; a session ends
    where no event follows within the gap."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drop_repeats(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Events delivered again within the watermark go."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def follow(stream: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to an index function. Batches that a restart delivers again
    carry the same number."""
    return stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
