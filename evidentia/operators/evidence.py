"""Canonical rows from candidates, joins of intents and results, quarantine, and small read models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_tests(candidates: DataFrame, keys: list[str], authority: str, description: str, content: str, outcome: str, complete: str, order: list[str]) -> DataFrame:
    """Per key: the description of the highest authority, the content hash only if all agree, and the outcome of the best
    completed candidate (unknown without one)."""
    place = F.struct(authority, *order)
    done = F.when(F.col(complete), place)
    return candidates.groupBy(*keys).agg(
        F.max_by(description, place).alias("description"), F.when(F.min(content) == F.max(content), F.min(content)).alias("content"),
        F.coalesce(F.max_by(F.when(F.col(complete), F.col(outcome)), done), F.lit("unknown")).alias("outcome"), F.count(F.lit(1)).alias("candidates"))


def canonical_files(observations: DataFrame, keys: list[str], source: str, authority: str, success: str, at: str) -> DataFrame:
    """Per key: the owner is the source of the highest authority (the least such source); the row counts only if the
    owner saw success; its instant is the earliest that any successful source gives."""
    owner = F.min(F.struct(-F.col(authority), F.col(source), (~F.col(success)).alias("failed")))
    found = observations.groupBy(*keys).agg(owner.alias("_o"), F.min(F.when(F.col(success), F.col(at))).alias("observed_at"), F.count(F.lit(1)).alias("told"))
    return found.where(~F.col("_o.failed")).select(*keys, F.col(f"_o.{source}").alias("owner"), "observed_at", "told")


def call_results(intents: DataFrame, results: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Intents and results of calls in whatever order they came; a reused call id is its last intent. kind tells what
    there is: complete, intent_only or result_only. intents: keys, at, intent; results: keys, at, result."""
    last = intents.groupBy(*keys).agg(F.max_by("intent", at).alias("intent"))
    done = results.groupBy(*keys).agg(F.max_by("result", at).alias("result"))
    both = last.join(done, keys, "full_outer")
    return both.withColumn("kind", F.when(F.col("intent").isNull(), "result_only").when(F.col("result").isNull(), "intent_only").otherwise("complete"))


def either_key(left: DataFrame, right: DataFrame, left_keys: list[str], right_key: str) -> DataFrame:
    """left rows joined with right rows that match any of the left keys: one join of equal keys each, put together, so no
    pair is tested that shares nothing."""
    found = [left.where(F.col(k).isNotNull()).join(right, F.col(k) == F.col(right_key)) for k in left_keys]
    return reduce(DataFrame.unionByName, found).distinct()


def quarantine(staged: DataFrame, keys: list[str], order: str, identity: str, expired: Column, wrong: Column, malformed: Column) -> DataFrame:
    """Adds the category of each staged record: malformed, expired, wrong_capability, duplicate (its identity came before),
    out_of_order (not after what was accepted) or accepted."""
    first = Window.partitionBy(identity).orderBy("_arrival")
    before = Window.partitionBy(*keys).orderBy("_arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = staged.withColumn("_early", F.when(malformed, "malformed").when(expired, "expired").when(wrong, "wrong_capability"))
    rows = rows.withColumn("_early", F.coalesce("_early", F.when(F.row_number().over(first) > 1, "duplicate")))
    # accepted orders only grow, so the greatest order of any sound record before is the greatest accepted one
    top = F.max(F.when(F.col("_early").isNull(), F.col(order))).over(before)
    return rows.withColumn("category", F.coalesce("_early", F.when(F.col(order) <= top, "out_of_order"), F.lit("accepted"))).drop("_early")


def readiness(tasks: DataFrame, keys: list[str], family: str, excluded: Column) -> DataFrame:
    """Per key whether two tasks of one family can be compared, and the reason where not."""
    counts = tasks.groupBy(*keys, family).agg(F.count_if(~excluded & F.col(family).isNotNull()).alias("n"), F.count(F.lit(1)).alias("all"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("largest_family"), F.sum("all").alias("tasks"))
    reason = F.when(F.col("tasks") < 2, "too_few_tasks").when(F.col("largest_family") < 2, "no_common_family").otherwise("none")
    return best.withColumns({"ready": F.col("largest_family") >= 2, "reason": reason})


def upsert_catalog(observed: DataFrame, key: str, name: str, from_config: str, at: str) -> DataFrame:
    """Per key the name that counts (configured before derived, then the latest) and when it was last seen."""
    return observed.groupBy(key).agg(F.max_by(name, F.struct(from_config, at, name)).alias(name), F.max(at).alias("last_seen"))


def overview(tasks: DataFrame, keys: list[str], at: str, ref: str, amount: str, n: int = 10) -> DataFrame:
    """Per key: the latest task, how many, their amount, and the n most recent as a list."""
    recent = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(ref))
    top = tasks.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= n)
    listed = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", ref))), lambda x: x[ref]).alias("recent"), F.max(F.when(F.col("_r") == 1, F.col(ref))).alias("latest"))
    sums = tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"), F.sum(amount).alias("amount"))
    return sums.join(listed, keys)
