"""Where a source belongs: its predecessor under another name, and the working tree that all its threads point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _prefixes(lines: DataFrame, of: list[str], line: str, content: str) -> DataFrame:
    """Adds `_n`, how many lines there are up to each one, and `_p`, which stands for them: sums of two hashes of (number,
    content)."""
    so_far = Window.partitionBy(*of).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lambda seed: F.sum(F.xxhash64(F.lit(seed), line, F.col(content).isNull(), content).cast("decimal(20,0)")).over(so_far)
    return lines.withColumns({"_p": F.struct(told(1).alias("a"), told(2).alias("b")), "_n": F.count(F.lit(1)).over(so_far)})


def prefix_lineage(known: DataFrame, current: DataFrame, group: list[str], line: str, content: str) -> DataFrame:
    """Per current source of a group the known one that it continues, repeats or cuts short: all lines that both have are
    equal. The longest shared part wins, then the greatest key.

    known: group, logical, line, content; current: group, source, line, content; lines are numbered without gaps. Two
    sources meet only by a prefix that is equal in both and whole in one, and of the known ones with an equal prefix only
    the greatest is told, so nothing is paired that doesn't match.
    """
    at = [*group, "_n", "_p"]
    olds, news = _prefixes(known, [*group, "logical"], line, content), _prefixes(current, [*group, "source"], line, content)
    ends = lambda rows, of: rows.groupBy(*group, of).agg(F.max_by("_p", "_n").alias("_p"), F.max("_n").alias("_n"))
    longer = ends(news, "source").join(olds.groupBy(*at).agg(F.max("logical").alias("logical")), at)
    shorter = news.select(*at, "source").join(ends(olds, "logical").groupBy(*at).agg(F.max("logical").alias("logical")), at)
    columns = [*group, "source", "logical", "_n"]
    best = longer.select(*columns).unionByName(shorter.select(*columns)).groupBy(*group, "source").agg(F.max(F.struct(F.col("_n").alias("shared"), "logical")).alias("_b"))
    return best.select(*group, "source", F.col("_b.logical").alias("logical"), F.col("_b.shared").alias("shared"))


def worktrees(threads: DataFrame, sessions: DataFrame, trusted: DataFrame, roots: DataFrame) -> DataFrame:
    """Per source its project and worktree, or why there is none: unavailable (a thread is unknown or untrusted, or no root
    is configured) or ambiguous (several places or roots).

    threads: source, thread (null for a source without any); sessions: thread, project, worktree; trusted: thread, project;
    roots: project, worktree, root.
    """
    known = sessions.join(trusted.select("thread", "project").distinct(), ["thread", "project"], "left_semi").select("thread", "project", "worktree").distinct()
    met = threads.select("source", "thread").distinct().join(known, "thread", "left")
    place = F.when(F.col("project").isNotNull(), F.struct("project", "worktree"))
    found = met.groupBy("source").agg(F.count_if(F.col("project").isNull()).alias("_lost"), F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    n_roots = roots.groupBy("project", "worktree").agg(F.count_distinct("root").alias("_roots"))
    rows = found.select("source", "_lost", "_lo", "_hi", F.col("_lo.project").alias("project"), F.col("_lo.worktree").alias("worktree")).join(n_roots, ["project", "worktree"], "left")
    why = (
        F.when(F.col("_lost") > 0, "unavailable").when(F.col("_lo") != F.col("_hi"), "ambiguous")
        .when(F.col("_roots").isNull(), "unavailable").when(F.col("_roots") > 1, "ambiguous")
    )
    judged = rows.withColumn("diagnostic", why)
    sound = F.col("diagnostic").isNull()
    return judged.select("source", F.when(sound, F.col("project")).alias("project"), F.when(sound, F.col("worktree")).alias("worktree"), "diagnostic")
