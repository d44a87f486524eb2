"""Calls of tools: which result answers which command, the test runs that they prove, and how runs were repeated.

A call's identity can be used again, and a command can be declined, so results are not simply joined by identity: the
commands and rejections of an identity cut its events into generations, whatever order the events arrived in, and a
result answers the command of its own generation. A result that follows a rejection, or that no command precedes,
answers nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much is known of the result of a command.
COMPLETE, INTENT_ONLY = "complete", "intent_only"


def generations(events: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Adds `generation`, the number of commands and rejections up to each event of its key. events: keys, place, kind
    (intent, result or rejection)."""
    so_far = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("generation", F.count_if(F.col("kind") != "result").over(so_far))


def executions(events: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """A row per command: keys, generation, the place and `intent` of the command, the last `result` of its generation with
    `results` (how many there are), and whether it was `rejected` after that. events: also intent, result."""
    at = F.struct(*place)
    head = F.col("kind") != "result"
    cut = generations(events, keys, place).groupBy(*keys, "generation").agg(
        F.max(F.when(head, F.col("kind"))).alias("_head"), F.max(F.when(head, at)).alias("_at"), F.max_by("intent", F.when(F.col("kind") == "intent", at)).alias("intent"),
        F.max_by("result", F.when(~head, at)).alias("result"), F.count_if(~head).alias("results"))
    following = F.lead("_head").over(Window.partitionBy(*keys).orderBy("generation"))
    told = cut.withColumn("rejected", F.coalesce(following == "rejection", F.lit(False))).where("_head = 'intent'")
    return told.select(*keys, "generation", *[F.col(f"_at.{c}").alias(c) for c in place], "intent", "result", "results", "rejected")


def canonical_runs(found: DataFrame, keys: list[str]) -> DataFrame:
    """One test run per call: what the highest authority says was run, and the best result that any source has of it.

    found: keys, authority, source, line, command_hash, is_test, runner, scope, completeness, exit_status, outcome, cause,
    observed_ns, turn_id. A call of which the highest authority tells several commands is ambiguous, one that it doesn't
    hold for a test is none, and a run without any result is no run; all of these give no row. The result is of the same
    command: a complete one before any other, then by authority.
    """
    whole = Window.partitionBy(*keys)
    rank = ["authority", "source", "line"]
    is_top = F.col("authority") == F.col("_top")
    told = found.withColumn("_top", F.max("authority").over(whole)).withColumns({
        "_lo": F.min(F.when(is_top, F.col("command_hash"))).over(whole), "_hi": F.max(F.when(is_top, F.col("command_hash"))).over(whole),
        "_told": F.max(F.when(is_top, F.struct(*rank, "is_test", "runner", "scope", "observed_ns", "turn_id"))).over(whole)})
    own = told.where((F.col("_lo") == F.col("_hi")) & F.col("_told.is_test") & F.col("is_test") & (F.col("command_hash") == F.col("_lo")))
    ended = F.col("completeness") != INTENT_ONLY
    best = F.max(F.struct((F.col("completeness") == COMPLETE).alias("whole"), ended.alias("ended"), *rank, "exit_status", "outcome", "cause", "completeness", "observed_ns", "turn_id"))
    runs = own.groupBy(*keys, F.col("_lo").alias("command_hash")).agg(best.alias("_b"), F.first("_told").alias("_t"), F.count(F.lit(1)).alias("candidates"))
    return runs.where("_b.ended").select(
        *keys, "command_hash", "_t.runner", "_t.scope", "_b.exit_status", "_b.outcome", "_b.cause", "_b.completeness", "_b.source", "_b.line",
        F.coalesce("_b.observed_ns", "_t.observed_ns").alias("observed_ns"), F.coalesce("_b.turn_id", "_t.turn_id").alias("turn_id"), "candidates")


def repeated(runs: DataFrame, writes: DataFrame, session: str, command: str, place: list[str]) -> DataFrame:
    """Adds to each run its `attempt` among the runs of a session and command, and as `retry` what a success says about
    the run before it: infra_recovery, product_fix_verification (something was written strictly between the two),
    flaky_retry or unknown_recovery; none for the first run, and for any that isn't a success.

    runs: session, command, place, outcome, cause. writes: session, place. Nulls of the first column of place come last.
    """
    order: list[Column] = [F.col(place[0]).asc_nulls_last(), *map(F.col, place[1:])]
    rest = [c for c in runs.columns if c not in (session, *place)]
    lined = runs.withColumn("_w", F.lit(0)).unionByName(writes.select(session, *place, *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in rest], F.lit(1).alias("_w")))
    up_to = Window.partitionBy(session).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(session, *place)
    counted = lined.withColumns({"_upto": F.sum("_w").over(up_to), "_here": F.sum("_w").over(level)}).where("_w = 0")
    own = Window.partitionBy(session, command).orderBy(*order)
    before = {c: F.lag(c).over(own) for c in ("outcome", "cause", "_upto")}
    between = F.col("_upto") - F.col("_here") - before["_upto"] > 0
    kind = F.when(before["cause"] == "infra_failure", "infra_recovery").when(before["cause"] == "product_failure", F.when(between, "product_fix_verification").otherwise("flaky_retry"))
    kind = kind.when(before["outcome"] != "success", "unknown_recovery").otherwise("none")
    told = F.when((F.col("outcome") == "success") & before["outcome"].isNotNull(), kind).otherwise("none")
    return counted.withColumns({"attempt": F.row_number().over(own).cast("long"), "retry": told}).drop("_w", "_upto", "_here")


def spans(ends_and_starts: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """A row per call from its starts and ends, in whatever order they came: the name and category from its last start
    (else its last end), the first start, the last end with its state, and the latency: the one an end tells, else the
    time between the two; `reversed` if the end lies before the start, which has no latency.

    ends_and_starts: keys, place, kind (start or end), tool, category, at_ns, state, latency_ms, turn_id.
    """
    at = F.struct(*place)
    start, end = F.when(F.col("kind") == "start", at), F.when(F.col("kind") == "end", at)
    made = ends_and_starts.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.struct("tool", "category"), start), F.max_by(F.struct("tool", "category"), end)).alias("_t"), F.min(F.when(F.col("kind") == "start", F.col("at_ns"))).alias("started_ns"),
        F.max_by("at_ns", end).alias("finished_ns"), F.coalesce(F.max_by("state", end), F.lit("unknown")).alias("state"),
        F.max_by("latency_ms", F.when(F.col("latency_ms").isNotNull(), end)).alias("_told"), F.coalesce(F.max_by("turn_id", start), F.max_by("turn_id", end)).alias("turn_id"))
    between = F.col("finished_ns") - F.col("started_ns")
    return made.select(
        *keys, "_t.tool", "_t.category", "started_ns", "finished_ns", "state", F.coalesce("_told", F.when(between >= 0, F.floor(between / 1_000_000))).alias("latency_ms"), "turn_id",
        F.coalesce(between < 0, F.lit(False)).alias("reversed"))
