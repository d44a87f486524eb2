"""Read models over materialised tables: catalog snapshots, task listings, refresh plans, work and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog(projects: DataFrame, pending: DataFrame, reports: DataFrame, key: str, revision: str, fence: Column) -> DataFrame:
    """The whole catalog in one plan: per project its reports at the current revision (those that pass the fence), the
    newest revision, and whether work is pending. projects, pending, reports: key and what is named."""
    current = reports.where(fence).groupBy(key).agg(F.count(F.lit(1)).alias("reports"), F.max(revision).alias("revision"))
    waits = pending.select(key).distinct().withColumn("pending", F.lit(True))
    rows = projects.join(current, key, "left").join(waits, key, "left")
    return rows.withColumns({"reports": F.coalesce("reports", F.lit(0).cast("long")), "pending": F.coalesce("pending", F.lit(False)), "empty": F.col("reports").isNull()})


def selected(snapshot: DataFrame, details: DataFrame, key: str, chosen: str) -> DataFrame:
    """A snapshot with the details of one chosen project; all others come without."""
    return snapshot.join(details.where(F.col(key) == chosen), key, "left").withColumn("selected", F.col(key) == chosen)


def content_digest(content: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)


def listed(tasks: DataFrame, content: list[str], digest: str) -> DataFrame:
    """Tasks with `intact`: whether the stored digest is that of the content."""
    return tasks.withColumn("intact", F.coalesce(F.col(digest) == content_digest(content), F.lit(False)))


def task(tasks: DataFrame, ref: str, wanted: str):
    """The one task of this reference; KeyError without any."""
    found = tasks.where(F.col(ref) == wanted).limit(1).collect()
    if not found:
        raise KeyError(wanted)
    return found[0]


def pilot_state(pilot_tasks: DataFrame, reports: DataFrame, ref: str, digest: str) -> DataFrame:
    """Per pilot its tasks, those with a report of the same digest, with another, and without any; `ready` if all have the
    same. pilot_tasks: pilot, ref, digest; reports: ref, digest."""
    met = pilot_tasks.join(reports.select(ref, F.col(digest).alias("_report")).dropDuplicates([ref]), ref, "left")
    same = F.coalesce(F.col("_report") == F.col(digest), F.lit(False))
    sums = met.groupBy("pilot").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(same).alias("matching"), F.count_if(F.col("_report").isNull()).alias("missing"))
    return sums.withColumn("stale", F.col("tasks") - F.col("matching") - F.col("missing")).withColumn("ready", F.col("tasks") == F.col("matching"))


def refresh_plan(found: DataFrame, cached: DataFrame, place: list[str], source: str, state: list[str]) -> DataFrame:
    """Per place (project and worktree) how many of the discovered sources are new, changed, or as they were when cached;
    `refresh` unless all are. found, cached: source and state; found: place."""
    before = cached.dropDuplicates([source]).select(source, F.struct(*state).alias("_was"))
    met = found.join(before, source, "left").withColumn("_now", F.struct(*state))
    sums = met.groupBy(*place).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("_was").isNull()).alias("new"), F.count_if(F.col("_was").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_was"))).alias("changed"))
    return sums.withColumn("reused", F.col("sources") - F.col("new") - F.col("changed")).withColumn("refresh", F.col("new") + F.col("changed") > 0)


def pending_work(items: DataFrame, group: list[str], item: str, eligible: Column, order: list[str]) -> DataFrame:
    """Per group its open items, how many may run now, and the one that is next."""
    place = F.struct(*order, item)
    sums = items.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(eligible).alias("eligible"), F.min(F.when(eligible, place)).getField(item).alias("next"))
    return sums.withColumn("any_eligible", F.col("eligible") > 0)


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per rule: passed, failed (with how many rows break it) or unknown, where every row leaves it open."""
    counts = df.agg(*[F.count_if(~rule).alias(f"f_{n}") for n, rule in rules.items()], *[F.count_if(rule.isNotNull()).alias(f"k_{n}") for n, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"f_{n}").alias("failures"), F.col(f"k_{n}").alias("_known")) for n in rules])
    each = counts.select(F.explode(rows).alias("r")).select("r.*")
    return each.select("check", F.when(F.col("_known") == 0, "unknown").when(F.col("failures") == 0, "passed").otherwise("failed").alias("state"), "failures")


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    own = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_at", F.row_number().over(own)).where("_at = 1").drop("_at")
