"""The same measures over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.operators.analytics import UNITS


def stream(spark, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def trend(events: DataFrame, window: str = "hourly", late: str = "1 hour") -> DataFrame:
    """Counts and means by tumbling window and type; rows later than `late` are left out. Batch tables work too."""
    length = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 days"}[window]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    start = {"window": F.window("ts", length, startTime="4 days") if window == "weekly" else F.window("ts", length)}["window"]  # weeks start on Monday
    return rows.groupBy(start.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("event_count"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("bucket"), "event_type", "event_count", "avg_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A row per user's session."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("event_count")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "event_count")


__all__ = ["UNITS", "sessions", "stream", "trend"]
