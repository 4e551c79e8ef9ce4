"""Streams of log events: windowed counts with a watermark (an extension; the batch forms have the same results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n, total of events; `late`: how long a stream waits for late ones."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, n of runs of events with no longer pause than the gap."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
