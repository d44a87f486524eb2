"""At-least-once event streams made exact: keyed inserts, dirty keys, and per-turn state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files_as_stream(spark: SparkSession, folder: str, glob: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def append_once(stream: DataFrame, key: str, out: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> None:
    """Writes each key's first row to out, once, and returns when what is there now has been read. With a watermark
    (column, delay) old keys leave the state; without one, state grows with the keys."""
    first = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key]) if watermark else stream.dropDuplicates([key])
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def recompute_dirty(stream: DataFrame, key: str, buckets: int, facts: str, out: str, checkpoint: str, summarise) -> None:
    """Each batch is appended to the facts under its batch id (a batch that runs again overwrites itself); then only the
    buckets with keys that it touched are summarised anew, over all their facts, and replaced."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("bucket", bucket).persist()
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(facts)
        dirty = batch.select("bucket").distinct()  # as many rows as buckets at most
        own = spark.read.parquet(facts).join(F.broadcast(dirty), "bucket", "left_semi").drop("batch")
        summarise(own).withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
        batch.unpersist()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


TURN_OUT = "turn_key string, sequence long, request string, outcome string"
TURN_STATE = "last long, request string, digest string, stopped boolean"


def judge_annotations(stream: DataFrame) -> DataFrame:
    """turn_key, sequence, request, outcome of annotations (turn_key, sequence, request, digest, kind): accepted,
    retry (the last request again), conflict (its content changed, or its sequence is taken), out_of_order, or stopped
    after the turn has ended. State is one row per turn."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, request, digest, stopped = state.get if state.exists else (-1, None, None, False)
        for batch in batches:
            found = []
            for row in batch.sort_values(["sequence", "request"], kind="stable").itertuples(index=False):
                if row.request == request:
                    outcome = "retry" if row.digest == digest and row.sequence == last else "conflict"
                elif stopped:
                    outcome = "stopped"
                elif row.sequence == last:
                    outcome = "conflict"
                elif row.sequence < last:
                    outcome = "out_of_order"
                else:
                    outcome = "accepted"
                    last, request, digest, stopped = int(row.sequence), row.request, row.digest, row.kind == "finish"
                found.append((key[0], int(row.sequence), row.request, outcome))
            yield pd.DataFrame(found, columns=["turn_key", "sequence", "request", "outcome"])
        state.update((last, request, digest, stopped))

    return stream.groupBy("turn_key").applyInPandasWithState(judge, TURN_OUT, TURN_STATE, "append", GroupStateTimeout.NoTimeout)
