"""Streams of labelled events: counts in time windows and bouts as they end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of labels in windows; events later than the watermark are dropped. Runs on streams and tables alike."""
    e = events.withWatermark(time, late).groupBy(F.window(time, width), label).agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), label, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Spans of a key's events without a pause longer than ``gap``."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
