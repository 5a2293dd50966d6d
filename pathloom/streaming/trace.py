"""Running counters over a stream of search events; an extension, no reference operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "qid bigint, at timestamp, type string, g double"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events written as JSON lines, as a stream."""
    return spark.readStream.schema(SCHEMA).json(path)


def counters(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Events per window, query and type, with the largest cost; windows close when the watermark passes them."""
    grouped = events.withWatermark("at", late).groupBy(F.window("at", window), "qid", "type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("g")).select(F.col("window.start").alias("start"), "qid", "type", "n", "g")


def sessions(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of one query's events without a gap: start, end and number."""
    grouped = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "qid")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "qid", "n")
