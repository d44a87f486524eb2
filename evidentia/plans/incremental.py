"""The incremental queries: a stream over the events' files gives what a batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shared_folder
from ..streaming import incremental, trees
from .adapters import OBS, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    base = shared_folder(spark)
    return f"{base}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return incremental.files_as_stream(spark, sf_dir, "events.parquet", events.schema)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    folder = _folder(spark)
    twice = _stream(spark, sf_dir).select("event_id", "user_id", "event_type", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    incremental.append_once(twice, "event_id", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(twice.schema).parquet(f"{folder}/out")


@query(f"WITH {OBS} SELECT user_id, count(*) AS n, sum(amount)::BIGINT AS amount FROM obs GROUP BY user_id")
def stream_dirty(spark, sf_dir):
    folder = _folder(spark)
    rows = _stream(spark, sf_dir).select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("amount"))

    def summarise(facts: DataFrame) -> DataFrame:
        return facts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))

    incremental.recompute_dirty(rows, "user_id", 16, f"{folder}/facts", f"{folder}/out", f"{folder}/checkpoint", summarise)
    return spark.read.parquet(f"{folder}/out").select("user_id", "n", "amount")


# Users are sessions; a signup claims a parent, which is late for most, and every ninth user claims another one too.
_TREES = f"""WITH RECURSIVE {OBS}, c AS (SELECT user_id, min(p) AS lo, max(p) AS hi FROM (SELECT user_id, CASE WHEN event_type = 'signup' AND user_id % 5 <> 0 THEN CASE WHEN user_id % 9 = 4 AND k > 90 THEN user_id // 3 ELSE user_id // 2 END END AS p FROM obs) GROUP BY user_id),
n AS (SELECT c.user_id AS node, p.user_id AS parent FROM c LEFT JOIN c p ON p.user_id = c.lo AND c.lo = c.hi AND p.user_id <> c.user_id),
r AS (SELECT node, node AS root FROM n WHERE parent IS NULL UNION ALL SELECT n.node, r.root FROM n JOIN r ON n.parent = r.node)"""


@query(_TREES + """ SELECT root, count(DISTINCT user_id) AS sessions, count(*) AS facts, sum(amount)::BIGINT AS amount FROM r JOIN obs ON user_id = node GROUP BY root""")
def stream_trees(spark, sf_dir):
    """The events arrive in three batches, and a fifth of them again in the last; the trees are those of all at once."""
    folder = _folder(spark)
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    claim = F.when((F.col("event_type") == "signup") & (user % 5 != 0), F.floor(user / F.when((user % 9 == 4) & (k > 90), 3).otherwise(2)))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_key"), user.alias("session"), claim.alias("parent"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    part, files = F.pmod(F.xxhash64("event_key"), F.lit(3)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for number in range(3):
        again = rows.where((part == number) | ((F.pmod(F.xxhash64("event_key"), F.lit(5)) == 0) if number == 2 else F.lit(False)))
        # a batch is a number of files, so no task writes all of it
        again.repartition(files, "event_key").write.mode("append").parquet(f"{folder}/in")
    stream = incremental.files_as_stream(spark, f"{folder}/in", "*.parquet", rows.schema, per_trigger=files)

    def summed(facts: DataFrame) -> DataFrame:
        return facts.groupBy("root").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("facts"), F.sum("amount").alias("amount"))

    trees.rederive(stream, folder, f"{folder}/checkpoint", summed)
    return trees.summaries(spark, folder, "sessions long, facts long, amount long")
