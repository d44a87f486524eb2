"""Cumulative counters: epochs between resets, their totals, and consecutive deltas.

Null means not observed, never zero. Rows are taken in the order of the columns given, and those without an instant (or
another of these) come last. Keys that are null are one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _last(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _place(order: list[str]) -> Column:
    """The same order as a value to compare."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def with_epochs(df: DataFrame, keys: list[str], order: list[str], components: list[str], epoch: str = "epoch") -> DataFrame:
    """Adds the epoch: it grows by one where any component falls below the row before. For complete vectors; one
    shuffle on the keys serves both windows."""
    ordered = Window.partitionBy(*keys).orderBy(*_last(order))
    fell = reduce(lambda a, b: a | b, [F.col(c) < F.lag(c).over(ordered) for c in components])
    marked = df.withColumn("_fell", F.coalesce(fell, F.lit(False)).cast("long"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(epoch, F.sum("_fell").over(running)).drop("_fell")


def with_epochs_over_gaps(df: DataFrame, keys: list[str], order: list[str], components: list[str], epoch: str = "epoch") -> DataFrame:
    """As with_epochs where components may be null: a component is compared with its last known value in this epoch,
    and a reset forgets all of them. Sorted rows stream through a task, which keeps one vector per open key."""
    schema = T.StructType([*df.schema.fields, T.StructField(epoch, T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, known, at = (), [None] * len(components), 0
        for batch in batches:  # whole numbers stay whole numbers: Arrow to Python's integers, and no way back
            columns = [batch.column(c).to_pylist() for c in (*keys, *components)]
            epochs = []
            for row in zip(*columns, strict=True):
                key, seen = row[: len(keys)], row[len(keys) :]
                if key != open_key:
                    open_key, known, at = key, [None] * len(components), 0
                if any(v is not None and k is not None and v < k for v, k in zip(seen, known)):
                    at, known = at + 1, [None] * len(components)
                known = [k if v is None else v for v, k in zip(seen, known)]
                epochs.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(epochs, pa.int64())], names=[*batch.schema.names, epoch])

    return df.repartition(*keys).sortWithinPartitions(*keys, *_last(order)).mapInArrow(scan, schema)


def final_totals(df: DataFrame, keys: list[str], order: list[str], components: list[str], epoch: str = "epoch") -> DataFrame:
    """Per key the sum over epochs of each component's last known value; null if an epoch never knew it."""
    place = _place(order)
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), place)).alias(c) for c in components]
    per_epoch = df.groupBy(*keys, epoch).agg(*last)
    return per_epoch.groupBy(*keys).agg(*[whole_sum(F.col(c)).alias(c) for c in components], F.count(F.lit(1)).alias("epochs"))


def component_maxima(df: DataFrame, keys: list[str], components: list[str], epoch: str = "epoch") -> DataFrame:
    """Per key and epoch each component's maximum: the other reducer, which a late lower value doesn't change."""
    return df.groupBy(*keys, epoch).agg(*[F.max(c).alias(c) for c in components])


def epoch_vectors(df: DataFrame, keys: list[str], at: str, order: list[str], components: list[str], epoch: str = "epoch") -> DataFrame:
    """Per key and epoch the last known value of each component, rows without an instant after all others; `ambiguous`
    where there is such a row. `least_*`: the value, or 0, and for an ambiguous epoch the greatest value seen."""
    place = F.struct(F.col(at).isNull(), F.coalesce(F.col(at), F.lit(0).cast("long")), *order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in components]
    top = [F.max(c).alias(f"_top_{c}") for c in components]
    found = df.groupBy(*keys, epoch).agg(*last, *top, F.bool_or(F.col(at).isNull()).alias("ambiguous"))
    least = [F.coalesce(F.when(F.col("ambiguous"), F.col(f"_top_{c}")).otherwise(F.col(c)), F.lit(0).cast("long")).alias(f"least_{c}") for c in components]
    return found.select(*keys, epoch, *components, *least, "ambiguous")


def whole_sum(c: Column) -> Column:
    """The sum, or null if any value is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def deltas(df: DataFrame, keys: list[str], order: list[str], component: str, epoch: str = "epoch", baseline: Column | None = None) -> DataFrame:
    """Adds `ordinal` (from 1, counted before anything is dropped) and `delta` to the row before in the epoch, the
    first one to the baseline (zero by default); rows with delta zero go."""
    ordered = Window.partitionBy(*keys, epoch).orderBy(*_last(order))
    start = F.lit(0).cast("long") if baseline is None else baseline
    delta = F.col(component) - F.coalesce(F.lag(component).over(ordered), start)
    return df.withColumn("ordinal", F.row_number().over(ordered).cast("long")).withColumn("delta", delta).where("delta IS NULL OR delta <> 0")


def without_repeats(df: DataFrame, keys: list[str], order: list[str], vector: list[str]) -> DataFrame:
    """Drops rows whose vector equals that of the row before."""
    ordered = Window.partitionBy(*keys).orderBy(*_last(order))
    now = F.struct(*vector)
    return df.withColumn("_before", F.lag(now).over(ordered)).where(~now.eqNullSafe(F.col("_before"))).drop("_before")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null up to each row."""
    ordered = Window.partitionBy(*keys).orderBy(*_last(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(ordered))
