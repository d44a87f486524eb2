"""Joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
#: A key with fewer rows than this is never split: one task reads them in no time.
HOT_ROWS = 250
SALTS = 32


def least_hot(total: int) -> float:
    """From how many rows on a key of `total` rows is hot."""
    return max(HOT_ROWS, HOT_SHARE * total)


def joined(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose weight tells how many rows to expect. Without a hot key
    that is a join as any other. Keys with at least HOT_SHARE of all weight are split over SALTS tasks: at most
    1 / HOT_SHARE of them, so the list of these is sent to all tasks, and only their table rows are copied. The table is
    read up to three times: it should be stored."""
    total, most = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    if most < least_hot(total):
        return rows.join(table.drop(weight), keys)
    is_hot = F.col(weight) >= F.lit(float(least_hot(total)))
    hot = table.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("_salt", F.explode(salts)).drop(weight), [*keys, "_salt"]).drop("_salt")
