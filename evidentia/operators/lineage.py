"""Forests of sessions: canonical roots, descendants up to a cutoff, and what a tree adds up to.

Edges are followed by joins, in rounds; every few rounds the lineage of the plan is cut by a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shared_folder
from .joins import joined, least_hot

MOST_SENT = 10_000  # rows


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of known size for a join: sent to all tasks up to MOST_SENT rows, else dealt by key, so that what passes
    through the driver doesn't grow with it."""
    return F.broadcast(df) if rows <= MOST_SENT else df.hint("merge")


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root. Parents that are null, unknown or the node itself end a chain; a cycle's root is its smallest node.

    Pointer jumping doubles the distance in every round, keeping the least node passed. A chain ends after as many rounds
    as the logarithm of its length. Nodes that lead into cycles never end: once a round ends no chain, reaches as many
    nodes as the round before (so these are the nodes of cycles) and passes no lesser node (so cycles are passed whole),
    all is known.
    """
    known = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p")).dropDuplicates(["n"])
    exists = known.select(F.col("n").alias("p"))
    linked = known.join(exists, "p", "left_semi").where("n <> p")
    every = _cut(known.select("n").join(linked, "n", "left").select("n", F.col("p").alias("next"), F.col("n").alias("least"), F.coalesce("p", "n").alias("last")))
    # nodes whose chain has ended are set aside: they are looked up, but looked at no more
    active, ended, reached = every.where("next IS NOT NULL"), [every.where("next IS NULL")], None
    while True:
        rows = active.groupBy("next").agg(F.count(F.lit(1)).alias("_rows"))
        n_next, n_active, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
        if n_active == 0:
            break
        ahead = reduce(DataFrame.unionByName, ended, active).select(F.col("n").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"), F.col("last").alias("_last"))
        met = active.join(ahead, "next") if most < least_hot(n_active) else joined(active, _cut(ahead.join(rows, "next")), ["next"], "_rows")
        moved = _cut(met.select("n", F.col("_next").alias("next"), F.least("least", "_least").alias("least"), F.col("_last").alias("last"), (F.col("_least") < F.col("least")).alias("lower")))
        n_ended, n_lower = moved.agg(F.count_if(F.col("next").isNull()), F.count_if("lower")).first()
        if n_ended == 0 and n_lower == 0 and n_next == reached:
            break
        reached, active = n_next if n_ended == 0 else None, moved.where("next IS NOT NULL").drop("lower")
        ended.append(moved.where("next IS NULL").drop("lower"))
    # what still has a next node leads into a cycle: its root is the least node that the cycle itself passes
    cycle = active.select(F.col("next").alias("_c")).distinct().join(active.select(F.col("n").alias("_c"), F.col("least").alias("_root")), "_c")
    rooted = active.join(cycle, F.col("next") == F.col("_c"), "left").select("n", F.coalesce("_root", "last").alias("root"))
    return reduce(DataFrame.unionByName, [e.select("n", F.col("last").alias("root")) for e in ended], rooted).select(F.col("n").alias(node), "root")


def descendants(nodes: DataFrame, node: str, parent: str, start: DataFrame, allowed: Column) -> DataFrame:
    """root, node, depth of all nodes reachable from the start nodes (one column `root`) through allowed nodes; each
    node once per root, at its least depth, so cycles end."""
    edges = nodes.where(allowed & F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(parent).alias("_p"), F.col(node).alias("_n")).distinct()
    edges = _cut(edges)
    front = _cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    found, rows = [front], front.count()  # a piece per depth: none is written again
    n_front = rows
    while n_front > 0:
        step = sent(found[-1], n_front).join(edges, F.col("node") == F.col("_p")).select("root", F.col("_n").alias("node")).distinct()
        before = reduce(DataFrame.unionByName, found).select("root", "node")
        front = _cut(step.join(sent(before, rows), ["root", "node"], "left_anti").withColumn("depth", F.lit(len(found))))
        n_front = front.count()
        rows += n_front
        if n_front > 0:
            found.append(front)
    return reduce(DataFrame.unionByName, found)


def rollup(members: DataFrame, facts: DataFrame, node: str, amount: str, distinct: str, at_us: str, cutoff: Column) -> DataFrame:
    """Per root: members, the amount, distinct observers, first and last instant up to the cutoff, elapsed ms.

    members: root, node. Facts are summed per node before they meet their tree, so a large tree moves sums, not facts.
    """
    inside = facts.where(cutoff)
    per_node = inside.groupBy(node).agg(F.sum(amount).alias("amount"), F.min(at_us).alias("first_at"), F.max(at_us).alias("last_at"), F.count(F.lit(1)).alias("facts"))
    sums = members.join(per_node, members["node"] == per_node[node], "left").groupBy("root").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.sum("amount").alias("amount"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    seen = members.join(inside.select(node, distinct).distinct(), members["node"] == F.col(node)).select("root", distinct).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("observers"))
    return sums.join(seen, "root", "left").select(
        "root", "members", "facts", "amount", F.coalesce("observers", F.lit(0)).alias("observers"), "first_at", "last_at",
        F.floor((F.col("last_at") - F.col("first_at")) / 1000).alias("elapsed_ms"))
