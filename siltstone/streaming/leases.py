"""Streaming counterparts (an addition of this library): heartbeats and sessions over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream, with event time as a zoned timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per type and window; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, lease: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """A seat's sessions: heartbeats with gaps below the lease; a session that ends is an expired seat."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", lease), "user_id").agg(F.count("*").alias("beats"))
    return held.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("expires"), "beats")
