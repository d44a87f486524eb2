"""Tasks out of sessions: which tree of sessions is one task, where it ends, and which of its sessions belong to it.

Every session is in exactly one tree, that of its root in the forest of accepted parents; a session whose parent is
unknown or ambiguous is a root itself, and a cycle's root is its least session. A task ends at the terminal that decides
its root's last turn, unless the root has been started again since; then, and without any terminal, it ends at the
last thing that is known of any of its sessions, and counts as incomplete.

All figures per root are aggregates, summed before they move; the one table that is joined to all sessions of a root has
a row per task, and large tasks are split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage
from .joins import joined

# How sure the instant of a lifecycle event is, from least to most.
TIMING = ("estimated", "model_reported", "derived", "exact")
ACCEPTED = ("confirmed", "inferred")


@dataclass
class Plans:
    """tasks: root, status, cutoff_ns, cutoff_source, cutoff_ordinal, timing, timing_conflicts, reopened, members.
    members: root, cutoff_ns, session_id, started_ns, depth (0 for the root, 1 for any other)."""

    tasks: DataFrame
    members: DataFrame


def accepted_parents(sessions: DataFrame) -> DataFrame:
    """session_id, started_ns and the parent that counts: a claim that is neither confirmed nor inferred doesn't."""
    return sessions.select("session_id", "started_ns", F.when(F.col("parent_kind").isin(*ACCEPTED), F.col("parent_id")).alias("parent_id"))


def _place(*first: str) -> Column:
    return F.struct(*[F.col(c) for c in first], F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("ordinal"), F.lit(-1).cast("long")))


def boundaries(roots: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """root, terminal (turn_id, kind, at, timing, source, ordinal), reopened and timing_conflicts, for roots with a
    terminal that can end them. roots: root, started_ns."""
    own = lifecycle.where("observed_ns IS NOT NULL").select(
        F.col("session_id").alias("root"), "turn_id", "kind", F.col("observed_ns").alias("at"), F.col("timing").cast("long").alias("timing"), "source", F.col("ordinal").cast("long").alias("ordinal"))
    own = own.join(roots, "root")
    is_start = F.col("kind") == "started"
    # a terminal can end its root if the session, or any turn of it, had begun by then
    begun = own.groupBy("root").agg(F.least(F.first("started_ns"), F.min(F.when(is_start, F.col("at")))).alias("_begun"))
    events = own.join(begun, "root").where(is_start | (F.col("at") >= F.col("_begun"))).drop("_begun", "started_ns")
    told = F.struct("turn_id", "kind", "at", "timing", "source", "ordinal")
    turns = events.groupBy("root", "turn_id").agg(
        F.max_by(told, F.when(~is_start, _place("timing", "at"))).alias("terminal"), F.max_by("at", F.when(is_start, _place("timing", "at"))).alias("began"))
    t = F.col("terminal")
    order = F.struct(F.coalesce("began", t["at"]), t["at"], t["timing"], F.coalesce("turn_id", F.lit("")), F.coalesce(t["source"], F.lit("")), F.coalesce(t["ordinal"], F.lit(-1).cast("long")))
    chosen = turns.where("terminal IS NOT NULL").groupBy("root").agg(F.max_by("terminal", order).alias("end"))

    end = F.col("end")
    other = F.col("turn_id").isNull() | end["turn_id"].isNull() | (F.col("turn_id") != end["turn_id"])
    placed = F.col("source").eqNullSafe(end["source"]) & F.col("ordinal").isNotNull() & end["ordinal"].isNotNull()
    at_once = F.when(placed, F.col("ordinal") > end["ordinal"]).otherwise(other)
    later = is_start & (other | (F.col("timing") >= end["timing"])) & ((F.col("at") > end["at"]) | ((F.col("at") == end["at"]) & at_once))
    weaker = ~is_start & F.col("turn_id").eqNullSafe(end["turn_id"]) & (F.col("timing") < end["timing"]) & (F.col("at") != end["at"])
    counted = events.join(chosen, "root").groupBy("root").agg(F.bool_or(later).alias("reopened"), F.count_if(weaker).alias("timing_conflicts"))
    return chosen.join(counted, "root")


def plans(sessions: DataFrame, lifecycle: DataFrame, activities: DataFrame) -> Plans:
    """sessions: session_id, parent_id, parent_kind, started_ns, a row each. lifecycle: session_id, turn_id, kind (started,
    completed, aborted), observed_ns, timing (place in TIMING), source, ordinal. activities: session_id, observed_ns.

    A task of which no instant is known has no plan, nor has one whose root starts after its own end. Sessions that start
    after the end of their task are no members of it.
    """
    known = accepted_parents(sessions)
    rooted = lineage._cut(lineage.roots(known, "session_id", "parent_id").join(known.select("session_id", "started_ns"), "session_id"))
    seen = activities.groupBy("session_id").agg(F.max("observed_ns").alias("_seen"))
    latest = rooted.join(seen, "session_id", "left").groupBy("root").agg(F.max(F.greatest("started_ns", "_seen")).alias("last_ns"), F.count(F.lit(1)).alias("_sessions"))
    roots = rooted.where("session_id = root").select("root", "started_ns")
    ends = boundaries(roots, lifecycle)
    ended = F.coalesce(F.col("end").isNotNull() & ~F.col("reopened"), F.lit(False))
    tasks = latest.join(ends, "root", "left").join(roots, "root").withColumn("_ended", ended).select(
        "root", F.when(F.col("_ended") & (F.col("end.kind") == "completed"), "complete").otherwise("incomplete").alias("status"),
        F.when(F.col("_ended"), F.col("end.at")).otherwise(F.col("last_ns")).alias("cutoff_ns"), F.when(F.col("_ended"), F.col("end.source")).alias("cutoff_source"),
        F.when(F.col("_ended"), F.col("end.ordinal")).alias("cutoff_ordinal"),
        F.when(F.col("_ended"), F.element_at(F.array(*map(F.lit, TIMING)), (F.col("end.timing") + 1).cast("int"))).otherwise("derived").alias("timing"),
        F.coalesce("timing_conflicts", F.lit(0).cast("long")).alias("timing_conflicts"), F.coalesce("reopened", F.lit(False)).alias("reopened"), "started_ns", "_sessions")
    tasks = lineage._cut(tasks.where("cutoff_ns IS NOT NULL AND (started_ns IS NULL OR started_ns <= cutoff_ns)").drop("started_ns"))
    within = joined(rooted, tasks.select("root", "cutoff_ns", "_sessions"), ["root"], "_sessions").where("started_ns IS NULL OR started_ns <= cutoff_ns")
    members = lineage._cut(within.select("root", "cutoff_ns", "session_id", "started_ns", (F.col("session_id") != F.col("root")).cast("int").alias("depth")))
    counted = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    return Plans(tasks.drop("_sessions").join(counted, "root"), members)
