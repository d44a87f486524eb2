"""What the operators share: reading a table, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import joined
from ..shipping import shared_folder, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs here go when it ends, not when the driver happens to collect its garbage:
    for queries whose result is stored."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored_at(df: DataFrame, what: str, *by: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and where it lies: lineage ends there, columns can be
    pruned, and a lost executor costs no recomputation of what came before. The tables of an application lie in one
    folder, which can be deleted when it has ended. Rows lie in folders by the columns named."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str) -> DataFrame:
    return stored_at(df, what)[0]


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that a slice holds about most_chars characters of text (one row at least)."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start, chars = 0, 0
        for i, value in enumerate(texts):
            chars += len(value or "")
            if chars >= most_chars:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, chars = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
