"""Trees that are derived anew as their facts arrive: late facts and late parents change only what they reach.

Each batch is stored under its number, and whatever it changes is written as a version of that number: a batch that runs
again reads the versions before its own and overwrites its own, so its result is the same. A reader takes the last
version of each key.

What a batch reaches: the sessions it tells of, their children and their parents, and with these the trees they were
in. All sessions of those trees, and no others, are put into trees again, and only these trees are summed up again. A
session that changes its tree thus takes its old and its new one with it, and a parent that arrives after its children
joins their trees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage

BUCKETS = 32


def _versions(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    """All stored rows of a table, or those of the batches before one; none if there is no table yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch int")
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last version of each key."""
    own = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), "batch").alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in own])


def _written(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *partitions).parquet(path)


MEMBERS = "session long, root long, parent_lo long, parent_hi long"


def members(spark: SparkSession, folder: str) -> DataFrame:
    """session, root, and the least and greatest parent that was claimed (one parent if they are equal)."""
    return latest(_versions(spark, f"{folder}/members", MEMBERS, None), "session")


def summaries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """root and what was summed up for it, of all trees that there are now. schema: of the columns besides root."""
    return latest(_versions(spark, f"{folder}/trees", f"root long, {schema}, gone boolean", None), "root").where("NOT gone").drop("gone")


def rederive(stream: DataFrame, folder: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame], per_bucket: int = BUCKETS) -> None:
    """Takes in what there is of a stream (event_key, session, parent and columns of facts) and returns. parent is the claim
    a row makes, or null; a session of which two parents are claimed has none. summarise takes the facts of whole trees, with
    `root`, and gives a row per root. An event_key that comes again counts as it came first.
    """
    spark = stream.sparkSession
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in stream.schema]
    bucket = F.pmod(F.xxhash64("session"), F.lit(per_bucket)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("event_key").agg(F.min(F.struct(*[c for c in batch.columns if c != "event_key"])).alias("_f")).select("event_key", "_f.*")
        _written(own.withColumns({"bucket": bucket, "batch": F.lit(number)}), f"{folder}/facts", "bucket")
        arrived = spark.read.schema(", ".join([*columns, "batch int", "bucket int"])).parquet(f"{folder}/facts").where(F.col("batch") == number)
        before = lineage._cut(latest(_versions(spark, f"{folder}/members", MEMBERS, number), "session"))

        told = arrived.groupBy("session").agg(F.min("parent").alias("_lo"), F.max("parent").alias("_hi"))
        touched = lineage._cut(told.join(before, "session", "left").select("session", "root", F.least("parent_lo", "_lo").alias("parent_lo"), F.greatest("parent_hi", "_hi").alias("parent_hi")))
        ids = touched.select("session")
        children = before.where("parent_lo = parent_hi").join(ids.withColumnRenamed("session", "parent_lo"), "parent_lo", "left_semi").select("session")
        near = ids.union(children).union(touched.where("parent_lo = parent_hi").select(F.col("parent_lo").alias("session"))).distinct()
        dirty = lineage._cut(before.join(near, "session", "left_semi").select("root").distinct())
        rest = before.join(dirty, "root", "left_semi").join(ids, "session", "left_anti")
        reached = rest.select("session", "parent_lo", "parent_hi").union(touched.select("session", "parent_lo", "parent_hi"))
        reached = lineage._cut(reached.withColumn("parent", F.when(F.col("parent_lo") == F.col("parent_hi"), F.col("parent_lo"))))
        placed = lineage.roots(reached, "session", "parent").join(reached.drop("parent"), "session")
        _written(placed.select("session", "root", "parent_lo", "parent_hi", F.lit(number).alias("batch")), f"{folder}/members")

        now = _versions(spark, f"{folder}/members", MEMBERS, None).where(F.col("batch") == number)
        buckets = now.select(bucket.alias("bucket")).distinct()  # as many rows as buckets at most
        facts = spark.read.schema(", ".join([*columns, "batch int", "bucket int"])).parquet(f"{folder}/facts").where(F.col("batch") <= number)
        facts = facts.join(F.broadcast(buckets), "bucket", "left_semi").join(now.select("session", "root"), "session")
        first = facts.groupBy("event_key").agg(F.min(F.struct("batch", *[c for c in facts.columns if c not in ("event_key", "batch", "bucket")])).alias("_f")).select("event_key", "_f.*")
        trees = summarise(first.drop("batch"))
        gone = dirty.join(now.select("root").distinct(), "root", "left_anti")
        rows = trees.withColumn("gone", F.lit(False)).unionByName(gone.select("root", F.lit(True).alias("gone")), allowMissingColumns=True)
        _written(rows.withColumn("batch", F.lit(number)), f"{folder}/trees")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
