"""Readers for the driver tables and the cue view that the interval queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z in microseconds: the zero of the cue clock.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cue_view(spark: SparkSession, sf_dir: str, scale: float = 300.0) -> DataFrame:
    """Events as cues: one media per user, ``value * scale`` seconds long, the event type as text."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"),
        F.col("event_id").alias("ord"),
        start.alias("start_time"),
        (start + F.col("value") * F.lit(float(scale))).alias("end_time"),
        F.col("event_type").alias("text"),
    )


def cue_sql(scale: float = 300.0) -> str:
    """The same view for DuckDB."""
    return (
        "SELECT user_id AS media_id, event_id AS ord, "
        f"(epoch_us(ts) - {EPOCH_US}) / 1000000.0::DOUBLE AS start_time, "
        f"(epoch_us(ts) - {EPOCH_US}) / 1000000.0::DOUBLE + value * {float(scale)}::DOUBLE AS end_time, "
        "event_type AS text FROM events"
    )
