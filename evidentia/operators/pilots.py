"""Pilot runs: a cohort of tasks per project, opened once, and closed with a decision over fixed gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_text, repeated_keys
from .facts import thresholds

# The bounds that a cohort has to keep.
LEAST_TASKS = 5
MOST_STAGING_MS = 2000
LEAST_COVERAGE, LEAST_TASK_COVERAGE = 0.85, 0.60


def started(runs: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """requests with `outcome`: started (the project has no open run and this sound request is its first), resumed (the
    parameters of the open or started run), refused (others) or invalid (no project, or a target below 1).

    runs: project, target, family, state; requests: project, target, family and the column that orders them,
    unique in a project.
    """
    sound = F.coalesce(F.col("project").isNotNull() & (F.col("target") >= 1), F.lit(False))
    opened = runs.where("state = 'open'").groupBy("project").agg(F.first(F.struct("target", "family")).alias("_open"))
    first = requests.where(sound).groupBy("project").agg(F.min(F.struct(order, "target", "family")).alias("_first"))
    rows = requests.join(opened, "project", "left").join(first, "project", "left")
    basis = F.coalesce("_open", F.struct(F.col("_first.target").alias("target"), F.col("_first.family").alias("family")))
    same = F.struct("target", "family").eqNullSafe(basis)
    outcome = (
        F.when(~sound, "invalid").when(F.col("_open").isNull() & (F.col(order) == F.col(f"_first.{order}")), "started")
        .when(same, "resumed").otherwise("refused")
    )
    return rows.select(*requests.columns, outcome.alias("outcome"))


def gates() -> dict[str, Column]:
    """The gates over a cohort's facts: target, completed, enrolled, failures, finish_missing, conflicts, issues, coverage,
    least_coverage and p95_ms. A fact that is unknown fails its gate."""
    c = F.col
    return {
        "enough_tasks": c("completed") >= F.greatest(F.lit(LEAST_TASKS), c("target")), "all_enrolled": c("enrolled") == c("completed"),
        "delivered": c("failures") == 0, "finished": c("finish_missing") == 0, "agreed": c("conflicts") == 0, "known_schema": c("issues") == 0,
        "covered": c("coverage") >= LEAST_COVERAGE, "each_covered": c("least_coverage") >= LEAST_TASK_COVERAGE, "fast": c("p95_ms") <= MOST_STAGING_MS,
    }


def decided(cohorts: DataFrame) -> DataFrame:
    """The facts with a boolean per gate, and whether the run may be closed as verified."""
    return thresholds(cohorts, gates())


def closed(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """runs (project, state, verified) with `outcome`: closed, or why not: not_open, missing_audit, malformed_audit,
    ambiguous_audit (several audits, or one that holds a key twice), changed_audit (its canonical text hasn't the digest
    it was given) or gates. audits: project, audit (JSON text), digest."""
    several = audits.groupBy("project").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("audit", "digest")).alias("_a"))
    text = F.col("_a.audit")
    repeated = repeated_keys(text)
    outcome = (
        F.when(F.coalesce(F.col("state") != "open", F.lit(True)), "not_open").when(F.col("_n").isNull() | text.isNull(), "missing_audit").when(F.col("_n") > 1, "ambiguous_audit")
        .when(repeated.isNull(), "malformed_audit").when(repeated, "ambiguous_audit").when(~F.sha2(canonical_text(text), 256).eqNullSafe(F.col("_a.digest")), "changed_audit")
        .when(F.coalesce("verified", F.lit(False)), "closed").otherwise("gates")
    )
    return runs.join(several, "project", "left").select(*runs.columns, outcome.alias("outcome"))
