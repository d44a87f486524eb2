"""Queries over conflicts, causes and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resolution
from .adapters import OBS, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {OBS}, o AS (SELECT user_id, event_type, event_id, CASE WHEN user_id % 2 = 0 THEN amount ELSE sum(abs(amount)) OVER u END::BIGINT AS amount,
  CASE WHEN user_id % 2 = 0 THEN k ELSE sum(abs(k)) OVER u END::BIGINT AS k FROM obs WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, coalesce(amount < lag(amount) OVER w, false) OR coalesce(k < lag(k) OVER w, false) AS fell FROM o WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT user_id, coalesce(bool_or(fell) OR max_by(k, (amount, k)) < max(k), false) AS conflict FROM f GROUP BY user_id""")
def counter_conflict_whole(spark, sf_dir):
    """All observations: users with an even number as they are, the others with running sums, which never fall."""
    so_far = Window.partitionBy("user_id").orderBy("event_id")
    as_is = F.col("user_id") % 2 == 0
    rows = observations(spark, sf_dir).withColumns({c: F.when(as_is, F.col(c)).otherwise(F.sum(F.abs(c)).over(so_far)) for c in ("amount", "k")})
    return resolution.counter_conflict(rows, ["user_id"], "event_type", "event_id", ["amount", "k"])


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_returnflag AS flag, l_quantity::BIGINT AS q, l_partkey, l_suppkey FROM lineitem)
SELECT key, min_by(flag, (l_partkey, l_suppkey, q, flag)) AS flag, min_by(q, (l_partkey, l_suppkey, q, flag)) AS q, count(*) AS told, count(DISTINCT (flag, q)) > 1 AS conflict FROM c GROUP BY key""")
def delta_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q"), "l_partkey", "l_suppkey")
    return resolution.once_per_event(rows, "key", ["flag", "q"], ["l_partkey", "l_suppkey", "q", "flag"])


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS r FROM orders)
SELECT o_orderkey, coalesce(d, r) AS cause, CASE WHEN d IS NOT NULL THEN 'derived' WHEN r IS NOT NULL THEN 'model_reported' ELSE 'estimated' END AS provenance, coalesce(d <> r, false) AS conflict FROM c""")
def cause_resolution(spark, sf_dir):
    found = resolution.cause(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, F.lit("F")))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'mcp' WHEN 'purchase' THEN 'file_write' WHEN 'signup' THEN 'apply_patch' ELSE 'unknown' END AS family,
  CASE WHEN event_type = 'signup' THEN 'a/b.py,c.md' ELSE '' END AS files, CASE WHEN event_type IN ('click', 'view') THEN event_type || ' one' END AS label, count(*) AS n FROM events GROUP BY event_type""")
def tool_names(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "click", "web.run").when(kind == "view", "mcp__x__y").when(kind == "purchase", "write_file").when(kind == "signup", "apply_patch").otherwise("rm")
    patch = F.when(kind == "signup", "*** Begin\n*** Update File: a/b.py\n+x\n*** Add File: c.md\n*** Delete File: a/b.py\n").otherwise("")
    given = F.when(kind == "click", F.lit("click  one")).when(kind == "view", F.lit("view one ")).when(kind == "purchase", F.lit("token: x")).when(kind == "signup", F.lit("a/b")).otherwise(F.lit("x\u0000"))
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", resolution.tool_family(name).alias("family"), F.array_join(resolution.patched_files(patch), ",").alias("files"), resolution.label(given).alias("label"), "n")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderdate < '1996-01-01' AND o_orderstatus = 'F') - 1000")
def delta_poll(spark, sf_dir):
    """What has changed since a reader's last revision, 1000 before the newest early order."""
    orders = table(spark, sf_dir, "orders")
    seen = orders.where("o_orderdate < '1996-01-01' AND o_orderstatus = 'F'").agg(F.max("o_orderkey")).first()[0]
    return resolution.changes_after(orders.select("o_orderkey"), "o_orderkey", seen - 1000)


QUERIES["counter_conflict"], ORACLES["counter_conflict"] = QUERIES["counter_conflict_whole"], ORACLES["counter_conflict_whole"]
