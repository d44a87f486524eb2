"""What a task's tree of sessions used: recorded, replayed and own tokens, time, and what is not known.

sessions: session_id, parent_id, started_ns. tokens: session_id, observed_ns, sequence and the COMPONENTS, cumulative.
roots: root, cutoff_ns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counters
from .intervals import contribution

COMPONENTS = ["input", "cached", "output", "reasoning"]
REPLAY_NS = 1_000_000_000


def members(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """root, cutoff_ns, session_id, started_ns, depth: sessions below a root that started by its cutoff. Each is a
    member once per root, however often it is reached."""
    from .lineage import _cut, sent

    known = _cut(sessions.select("session_id", "parent_id", "started_ns"))
    below = known.where("parent_id <> session_id")
    front = _cut(roots.join(known.hint("merge"), F.col("root") == F.col("session_id")).select("root", "cutoff_ns", "session_id", "started_ns", F.lit(0).alias("depth")))
    found, rows = [front], front.count()  # a piece per depth: none is written again
    n_front = rows
    while n_front > 0:
        up = sent(found[-1].select("root", "cutoff_ns", F.col("session_id").alias("parent_id")), n_front)
        step = up.join(below, "parent_id").where("started_ns IS NULL OR started_ns <= cutoff_ns").select("root", "cutoff_ns", "session_id", "started_ns").distinct()
        before = reduce(DataFrame.unionByName, found).select("root", "session_id")
        front = _cut(step.join(sent(before, rows), ["root", "session_id"], "left_anti").withColumn("depth", F.lit(len(found))))
        n_front = front.count()
        rows += n_front
        if n_front > 0:
            found.append(front)
    return reduce(DataFrame.unionByName, found)


def working(prefix: str = ""):
    return F.col(f"{prefix}input") - F.col(f"{prefix}cached") + F.col(f"{prefix}output")


def usage(sessions: DataFrame, tokens: DataFrame, activities: DataFrame, roots: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """A row per root: members, subagents, cycle_edges; recorded_*, baseline_* and unique_* of each component, working and
    full_context; wall_ms, agent_ms; observed and zero baselines; caveats. A component that a member never reported is null.

    activities: session_id, observed_ns. within: the members, as of tasks.plans; without it, what is reached from the roots.
    """
    tree = members(sessions, roots) if within is None else within
    inside = tokens.join(tree, "session_id").where("observed_ns <= cutoff_ns AND (started_ns IS NULL OR observed_ns >= started_ns)")
    per_root = ["root", "session_id"]
    epochs = counters.with_epochs(inside, per_root, ["observed_ns", "sequence"], COMPONENTS)
    replays = (F.col("epoch") == 0) & (F.col("observed_ns") <= F.col("started_ns") + REPLAY_NS) & (F.col("depth") > 0)
    replayed = F.max_by(F.struct(*COMPONENTS), F.when(replays, F.struct("observed_ns", "sequence"))).alias("_b")
    by_epoch = epochs.groupBy(*per_root, "epoch").agg(*[F.max(c).alias(c) for c in COMPONENTS], replayed)
    # the first epoch alone can hold a baseline
    totals = by_epoch.groupBy(*per_root).agg(*[counters.whole_sum(F.col(c)).alias(c) for c in COMPONENTS], F.first("_b", ignorenulls=True).alias("b"))
    last = activities.join(tree, "session_id").where("observed_ns <= cutoff_ns").groupBy(*per_root).agg(F.max("observed_ns").alias("last_ns"))

    rows = tree.join(totals, per_root, "left").join(last, per_root, "left")
    zero = F.lit(0).cast("long")
    base = {c: F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(zero) for c in COMPONENTS}
    rows = rows.withColumns({f"_b_{c}": x for c, x in base.items()})
    sums = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("members"), F.max("cutoff_ns").alias("cutoff_ns"), F.max(F.when(F.col("depth") == 0, F.col("started_ns"))).alias("_root_start"),
        *[counters.whole_sum(F.col(c)).alias(f"recorded_{c}") for c in COMPONENTS], *[counters.whole_sum(F.col(f"_b_{c}")).alias(f"baseline_{c}") for c in COMPONENTS],
        *[counters.whole_sum(contribution(F.col(c), F.col(f"_b_{c}"))).alias(f"unique_{c}") for c in COMPONENTS],
        counters.whole_sum(F.floor((F.col("last_ns") - F.col("started_ns")) / 1_000_000)).alias("agent_ms"),
        F.count_if(F.col("b").isNotNull()).alias("observed_baselines"), F.count_if((F.col("depth") > 0) & F.col("b").isNull()).alias("zero_baselines"), F.count_if(F.col("input").isNull()).alias("_silent"))
    links = tree.select("root", F.col("session_id").alias("parent_id")).join(sessions.select("session_id", "parent_id"), "parent_id").join(tree.select(*per_root), per_root, "left_semi")
    edges = links.groupBy("root").agg(F.count(F.lit(1)).alias("_edges"))
    told = F.filter(F.array(
        F.when(F.col("zero_baselines") > 0, F.concat(F.lit("zero_no_observation:"), F.col("zero_baselines"))),
        F.when(F.col("_silent") > 0, F.concat(F.lit("missing_final_token:"), F.col("_silent")))), lambda c: c.isNotNull())
    out = sums.join(edges, "root", "left").withColumns({
        "subagents": F.col("members") - 1, "cycle_edges": F.coalesce("_edges", zero) - (F.col("members") - 1), "wall_ms": F.floor((F.col("cutoff_ns") - F.col("_root_start")) / 1_000_000),
        "working": working("unique_"), "full_context": F.col("unique_input") + F.col("unique_output"), "caveats": told})
    return out.withColumn("provenance", F.when(F.size("caveats") == 0, "derived").otherwise("estimated")).drop("_edges", "_root_start", "_silent")


def allocate_hints(deltas: DataFrame, hints: DataFrame) -> DataFrame:
    """Deltas of sessions whose hints fit into them give way to the hints and what they leave over.

    deltas, hints: session_id, event_key, observed_ns and the COMPONENTS. Hints that together exceed a session's deltas in
    any component (or an unknown one) are not used. A remainder has no instant, and none is written if nothing is left.
    """
    total = lambda df, p: df.groupBy("session_id").agg(*[counters.whole_sum(F.col(c)).alias(f"{p}{c}") for c in COMPONENTS])
    both = total(deltas, "d_").join(total(hints, "h_"), "session_id")
    fits = F.lit(True)
    for c in COMPONENTS:
        fits = fits & F.coalesce(F.col(f"h_{c}") <= F.col(f"d_{c}"), F.lit(False))
    used = both.where(fits)
    ids = used.select("session_id")
    rest = used.select("session_id", F.concat(F.lit("residual:"), "session_id").alias("event_key"), F.lit(None).cast("long").alias("observed_ns"), *[(F.col(f"d_{c}") - F.col(f"h_{c}")).alias(c) for c in COMPONENTS])
    left = rest.where(" OR ".join(f"{c} <> 0" for c in COMPONENTS))
    columns = ["session_id", "event_key", "observed_ns", *COMPONENTS]
    kept = deltas.join(ids, "session_id", "left_anti").select(*columns).withColumn("origin", F.lit("delta"))
    own = hints.join(ids, "session_id", "left_semi").select(*columns).withColumn("origin", F.lit("hint"))
    return kept.unionByName(own).unionByName(left.withColumn("origin", F.lit("residual")))
