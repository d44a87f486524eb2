"""From session files to facts, in one call.

The lines are parsed once and stored; every kind of fact is a projection of them. Facts are keyed, so taking in the same
files again, or together with newer ones, changes nothing that was known.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants, keys
from ..operators import arbitration, tasks, tree, turns
from ..operators import calls as call_evidence
from ..shipping import shared_folder
from . import calls, rollout

# Kinds of lines that start or end a turn.
TURNS = {"event_msg/task_started": "started", "event_msg/task_complete": "completed", "event_msg/turn_aborted": "aborted"}
AUTHORITY = 3  # of session files
TIMING = tasks.TIMING.index("exact")  # of their instants


@dataclass
class Facts:
    """sessions: session_id, parent_id, parent_kind, started_ns, paths. tokens: event_key, session_id, observed_ns, sequence,
    counters, complete. activities: session_id, observed_ns. lifecycle: session_id, turn_id, kind, observed_ns,
    duration_ms, authority, timing, source, ordinal. spans: calls.spans. tests: canonical runs with their attempts.
    files: what calls read or wrote. diagnostics: path, code, lines."""

    sessions: DataFrame
    tokens: DataFrame
    activities: DataFrame
    lifecycle: DataFrame
    spans: DataFrame
    tests: DataFrame
    files: DataFrame
    diagnostics: DataFrame

    def plans(self) -> tasks.Plans:
        """The tasks of these sessions, where they end, and their members."""
        return tasks.plans(self.sessions, self.lifecycle, self.activities)

    def usage(self) -> DataFrame:
        """What each task's sessions used (tree.usage), with its status."""
        found = self.plans()
        used = tree.usage(self.sessions, self.tokens.where("complete AND observed_ns IS NOT NULL"), self.activities, found.tasks.select("root", "cutoff_ns"), found.members)
        return used.join(found.tasks.select("root", "status", "timing", "reopened"), "root")

    def attempts(self) -> DataFrame:
        return turns.attempts(self.lifecycle)


def claimed_parents(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """child, parent, kind: a session's own header confirms its parent; a session that tells of another's activity is
    taken for the other's parent."""
    own = headers.where("parent_id <> ''").select(F.col("session_id").alias("child"), F.col("parent_id").alias("parent"), F.lit("confirmed").alias("kind"))
    child = F.get_json_object("payload", "$.agent_thread_id")
    told = rows.where("route = 'event_msg/sub_agent_activity'").select(child.alias("child"), F.col("session_id").alias("parent"), F.lit("inferred").alias("kind")).where("child <> ''")
    return own.union(told).distinct()


def facts(spark: SparkSession, folder: str, key: bytes) -> Facts:
    """All facts of the *.jsonl below a folder. Lines of one session may lie in several files; equal lines at one place of
    a session's files count once."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
    rollout.parse(rollout.lines(spark, folder, key)).write.parquet(path)
    parsed = spark.read.parquet(path)
    headers = rollout.session_headers(parsed)
    rows = rollout.filled_forward(parsed).join(headers.select("path", "session_id", "cwd"), "path")
    claims = claimed_parents(headers, rows)
    parents = arbitration.resolve_parents(claims, "child", "parent", "kind").select(F.col("child").alias("session_id"), F.col("parent").alias("parent_id"), F.col("confidence_kind").alias("parent_kind"))
    started = instants.epoch_ns(F.col("started"))
    known = headers.select("session_id", started.alias("started_ns"), F.lit(1).alias("_path")).unionByName(claims.where("kind = 'inferred'").select(F.col("child").alias("session_id"), F.lit(None).cast("long").alias("started_ns"), F.lit(0).alias("_path")))
    sessions = known.groupBy("session_id").agg(F.min("started_ns").alias("started_ns"), F.sum("_path").alias("paths")).join(parents, "session_id", "left")
    tokens = rollout.token_snapshots(parsed, headers, key).withColumnRenamed("ordinal", "sequence").dropDuplicates(["event_key"])
    activities = rows.where("observed_ns IS NOT NULL").select("session_id", "observed_ns").distinct()
    kind = F.coalesce(*[F.when(F.col("route") == route, F.lit(what)) for route, what in TURNS.items()])
    turn = F.coalesce(F.get_json_object("payload", "$.turn_id"), "at_turn")
    lifecycle = rows.where(F.col("route").isin(*TURNS)).select(
        "session_id", turn.alias("turn_id"), kind.alias("kind"), "observed_ns", F.get_json_object("payload", "$.duration_ms").try_cast("long").alias("duration_ms"),
        keys.pseudonym("source", F.col("path"), key).alias("source"), "ordinal", "fingerprint")
    # equal lines at one place are one event, of the least source that tells it
    lifecycle = lifecycle.groupBy(*[c for c in lifecycle.columns if c != "source"]).agg(F.min("source").alias("source")).select(
        "session_id", "turn_id", "kind", "observed_ns", "duration_ms", F.lit(AUTHORITY).cast("long").alias("authority"), F.lit(TIMING).cast("long").alias("timing"), "source", "ordinal")
    of_calls = calls.call_lines(rows)
    files = calls.files(of_calls, key)
    runs = call_evidence.canonical_runs(calls.tests(of_calls, AUTHORITY, key), ["session_id", "call_key"])
    tests = call_evidence.repeated(runs, files.where("operation = 'write'").select("session_id", "observed_ns", "source", "line"), "session_id", "command_hash", ["observed_ns", "source", "line"])
    odd = F.col("route").isin("malformed", "invalid_encoding", *rollout.UNKNOWN_KIND.values(), "unknown_envelope")
    diagnostics = parsed.withColumn("code", F.when(odd, F.col("route")).when(F.col("quality") != "valid", F.concat(F.lit("timestamp_"), "quality"))).where("code IS NOT NULL").groupBy("path", "code").agg(F.count(F.lit(1)).alias("lines"))
    return Facts(sessions.select("session_id", "parent_id", "parent_kind", "started_ns", "paths"), tokens, activities, lifecycle, calls.spans(of_calls, key), tests, files, diagnostics)
