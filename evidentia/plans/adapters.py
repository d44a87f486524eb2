"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of sessions: user_id, event_id, at_us (microseconds), event_type, amount (hundredths), k."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type",
        F.round(F.col("value") * 100).cast("long").alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The same in DuckDB, to begin a WITH.
OBS = """obs AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, event_type, round(value * 100)::BIGINT AS amount,
  (props->>'$.k')::BIGINT AS k FROM events)"""
