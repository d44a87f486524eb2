"""Audits of reports: agreement of two models, issue counts, project statistics, lookups and trend assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import earlier

# Names of fields that a public structure must not have.
PRIVATE_FIELDS = (
    "absolute_path", "arguments", "capability", "command", "content", "database_path", "message", "path", "project_id", "prompt", "raw", "root",
    "root_id", "root_key", "session_id", "session_ids", "session_key", "source_root", "tool_output", "turn_id", "turn_key", "worktree_path",
)


def private_fields(kind: T.DataType, at: str = "") -> list[str]:
    """The places in a schema of fields with a private name; what is counted under a field *_counts are values, not names."""
    if isinstance(kind, T.ArrayType):
        return private_fields(kind.elementType, at)
    if isinstance(kind, T.MapType):
        return private_fields(kind.valueType, at)
    if not isinstance(kind, T.StructType):
        return []
    own = [f"{at}{f.name}" for f in kind.fields if f.name in PRIVATE_FIELDS and not at.endswith("_counts.")]
    return own + [p for f in kind.fields for p in private_fields(f.dataType, f"{at}{f.name}.")]


def public(df: DataFrame) -> DataFrame:
    """The table itself if no field of it is private; the schema tells, so no row is read."""
    found = private_fields(df.schema)
    if found:
        raise ValueError("private fields: " + ", ".join(found))
    return df


def disagreements(audited: DataFrame, reported: DataFrame, key: str, exact: list[str], if_known: list[str]) -> DataFrame:
    """key and field, a row for each field in which the models differ; `missing` for a key that one side lacks. Fields in
    if_known count only where the report knows them."""
    a = audited.select(key, F.struct(*exact, *if_known).alias("_a"))
    r = reported.select(key, F.struct(*exact, *if_known).alias("_r"))
    both = a.join(r, key, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_r").isNull()
    tests = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in exact]
    tests += [F.when(F.col(f"_r.{c}").isNotNull() & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in if_known]
    found = F.when(one_sided, F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*tests)))
    return both.select(key, F.explode(found).alias("field"))


def issue_counts(issues: DataFrame, sources: DataFrame, diagnostics: DataFrame, tasks: DataFrame, prefix: str) -> DataFrame:
    """Per project: all issues of its sources, and those that its tasks' diagnostics of this prefix account for.

    issues: source; sources: source, project; diagnostics: task, code, n; tasks: task, project.
    """
    total = issues.join(sources.select("source", "project"), "source").groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    own = diagnostics.where(F.col("code").startswith(prefix)).groupBy("task").agg(F.sum("n").alias("_n"))
    attributed = tasks.select("task", "project").join(own, "task").groupBy("project").agg(F.sum("_n").alias("attributed"), F.count(F.lit(1)).alias("tasks"))
    zero = F.lit(0).cast("long")
    both = total.join(attributed, "project", "full_outer")
    return both.select("project", *[F.coalesce(c, zero).alias(c) for c in ("total", "attributed", "tasks")])


def stats(reports: DataFrame, key: str, at: str) -> DataFrame:
    """Per key how many reports there are, and when the first and the last."""
    return reports.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def stale_stats(kept: DataFrame, reports: DataFrame, key: str, at: str) -> DataFrame:
    """Keys whose kept statistics aren't those of the reports, or that only one side has: key and `problem`."""
    now = stats(reports, key, at).select(key, F.struct("n", "first_at", "last_at").alias("_now"))
    both = kept.select(key, F.struct("n", "first_at", "last_at").alias("_kept")).join(now, key, "full_outer")
    problem = F.when(F.col("_kept").isNull(), "missing").when(F.col("_now").isNull(), "orphan").when(~F.col("_kept").eqNullSafe(F.col("_now")), "differs")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def in_newest(audits: DataFrame, evidence: DataFrame, key: str, audit: str, at: str, asked: Column) -> DataFrame:
    """The evidence asked for, from each key's newest audit alone. audits: key, audit, at; evidence: audit and its columns."""
    newest = audits.groupBy(key).agg(F.max_by(audit, F.struct(at, audit)).alias(audit))
    return evidence.where(asked).join(newest, audit)


def assess(tasks: DataFrame, family: list[str], at: str, ref: str, working: str, signals: list[str], n: int = 4) -> DataFrame:
    """Adds baseline2 (twice the median of the n comparable tasks before), `signal`, `warning` and `caveat`.

    A warning needs more work than the median and a signal above its own median; the first such signal in the order given
    corroborates. Without n tasks before, or with an unknown amount among them, there is a caveat and no warning. tasks:
    completed ones of a known family.
    """
    rows = earlier(tasks, family, at, ref, [working, *signals], n)
    low, high = (n - 1) // 2, n // 2

    def twice(name: str) -> Column:
        ordered = F.array_sort(F.transform("_last", lambda x: x[name]))
        return F.when(F.size(F.array_compact(ordered)) == n, F.get(ordered, F.lit(low)) + F.get(ordered, F.lit(high)))

    signal = F.coalesce(*[F.when(2 * F.col(s) > twice(s), F.lit(s)) for s in signals])
    caveat = F.when(F.size("_last") < n, "too_few_tasks").when(F.col("_base").isNull() | F.col(working).isNull(), "amount_unavailable").when(
        (2 * F.col(working) > F.col("_base")) & F.col("_signal").isNull(), "no_corroborating_signal")
    found = rows.withColumns({"_base": twice(working), "_signal": signal}).withColumn("caveat", caveat)
    grown = F.coalesce(2 * F.col(working) > F.col("_base"), F.lit(False))
    return found.select(*tasks.columns, F.col("_base").alias("baseline2"), F.when(grown, F.col("_signal")).alias("signal"), (grown & F.col("_signal").isNotNull()).alias("warning"), "caveat")
