"""Attempts, retries and other ordered events of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(events: DataFrame, keys: list[str], at: str, tie: str, start: Column, end: Column) -> DataFrame:
    """The starts, each with its attempt number, state (completed if an end comes before the next start) and duration."""
    ordered = Window.partitionBy(*keys).orderBy(at, tie)
    own = events.withColumns({"_start": start, "_end": end}).where("_start OR _end")
    led = own.withColumns({"_closed": F.lead("_end").over(ordered), "_closed_at": F.lead(at).over(ordered)}).where("_start")
    closed = F.coalesce(F.col("_closed"), F.lit(False))
    return led.withColumns({
        "attempt": F.row_number().over(ordered).cast("long"), "state": F.when(closed, "completed").otherwise("open"),
        "duration_ms": F.when(closed, F.floor((F.col("_closed_at") - F.col(at)) / 1000)),
    }).drop("_start", "_end", "_closed", "_closed_at")


def retries(events: DataFrame, keys: list[str], at: str, tie: str, is_run: Column, failed: Column, edited: Column) -> DataFrame:
    """The runs with their attempt number and, for a success after a failure, whether an edit lay strictly between."""
    ordered = Window.partitionBy(*keys).orderBy(at, tie)
    counted = events.withColumn("_edits", F.sum(edited.cast("long")).over(ordered)).withColumn("_failed", failed).where(is_run)
    marked = counted.withColumns({
        "attempt": F.row_number().over(ordered).cast("long"), "_before": F.lag("_failed").over(ordered), "_since": F.col("_edits") - F.lag("_edits").over(ordered)})
    kind = F.when(F.coalesce("_before", F.lit(False)) & ~F.col("_failed"), F.when(F.col("_since") > 0, "fix_verified").otherwise("flaky_retry")).otherwise("none")
    return marked.withColumn("retry", kind).drop("_edits", "_failed", "_before", "_since")


def latest(events: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, and how many were cut off."""
    ordered = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    placed = events.withColumns({"_place": F.row_number().over(ordered), "_all": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return placed.where(F.col("_place") <= n).withColumn("truncated", F.greatest(F.lit(0).cast("long"), F.col("_all") - n)).drop("_place", "_all")


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place ceil(share * n) of each key, with n."""
    rank = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").cast("long")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rank.alias(name))
