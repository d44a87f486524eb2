"""Queries over read models, and what trees of sessions used."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import snapshots, tree
from .adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT o_custkey AS c_custkey, count(*) AS reports, max(o_orderkey) AS revision FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey, coalesce(reports, 0) AS reports, revision, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS pending, reports IS NULL AS empty
FROM customer LEFT JOIN r USING (c_custkey)""")
def catalog_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    pending = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
    return snapshots.catalog(table(spark, sf_dir, "customer").select("c_custkey"), pending, orders, "c_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("c_custkey", "reports", "revision", "pending", "empty")


@query("""WITH b AS (SELECT n_name FROM nation WHERE n_nationkey = (SELECT min(s_nationkey) FROM supplier))
SELECT n_name, n_regionkey, s.s_suppkey, n_name = (SELECT n_name FROM b) AS selected FROM nation LEFT JOIN supplier s ON s_nationkey = n_nationkey AND n_name = (SELECT n_name FROM b)""")
def selected_snapshot(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    chosen = nation.join(supplier.agg(F.min("s_nationkey").alias("n_nationkey")), "n_nationkey").first()["n_name"]
    details = supplier.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("n_name", "s_suppkey")
    return snapshots.selected(nation.select("n_name", "n_regionkey"), details, "n_name", chosen)


@query("SELECT p_partkey, p_size <> 7 AS intact FROM part")
def task_listing(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("digest", snapshots.content_digest(["p_name", "p_size"]))
    altered = part.withColumn("p_size", F.when(F.col("p_size") == 7, 8).otherwise(F.col("p_size")))
    return snapshots.listed(altered, ["p_name", "p_size"], "digest").select("p_partkey", "intact")


@query("""WITH t AS (SELECT l_suppkey AS pilot, l_orderkey AS ref, max(l_linestatus) AS digest FROM lineitem GROUP BY ALL), m AS (SELECT pilot, t.digest, o_orderstatus AS report FROM t LEFT JOIN orders ON o_orderkey = ref AND o_orderpriority <> '5-LOW')
SELECT pilot, count(*) AS tasks, count_if(report = digest) AS matching, count_if(report IS NULL) AS missing, count_if(report <> digest) AS stale, bool_and(coalesce(report = digest, false)) AS ready FROM m GROUP BY pilot""")
def pilot_state(spark, sf_dir):
    tasks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pilot"), F.col("l_orderkey").alias("ref")).agg(F.max("l_linestatus").alias("digest"))
    reports = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("digest"))
    return snapshots.pilot_state(tasks, reports, "ref", "digest")


@query("""WITH f AS (SELECT s_suppkey, s_nationkey, s_acctbal < 0 AS wt, CASE WHEN s_acctbal > 9000 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, s_acctbal BETWEEN 5000 AND 6000 AS fresh, s_acctbal > 9000 AS moved FROM supplier)
SELECT s_nationkey, wt, count(*) AS sources, count_if(fresh) AS "new", count_if(moved AND NOT fresh) AS changed, count_if(NOT fresh AND NOT moved) AS reused, bool_or(fresh OR moved) AS refresh FROM f GROUP BY ALL""")
def refresh_plan(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") < 0).alias("wt"), "s_acctbal")
    found = supplier.withColumn("s_acctbal", F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return snapshots.refresh_plan(found, supplier.where("NOT s_acctbal BETWEEN 5000 AND 6000"), ["s_nationkey", "wt"], "s_suppkey", ["s_acctbal"])


@query("""SELECT o_custkey, count(*) AS total, count_if(o_orderpriority < '3') AS eligible, first(o_orderkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) FILTER (o_orderpriority < '3') AS next,
count_if(o_orderpriority < '3') > 0 AS any_eligible FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey""")
def pending_work(spark, sf_dir):
    return snapshots.pending_work(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderkey", F.col("o_orderpriority") < "3", ["o_orderpriority", "o_orderdate"])


@query("""SELECT 'positive' AS "check", CASE WHEN count_if(l_quantity <= 0) = 0 THEN 'passed' ELSE 'failed' END AS state, count_if(l_quantity <= 0) AS failures FROM lineitem
UNION ALL SELECT 'small', CASE WHEN count_if(l_quantity >= 40) = 0 THEN 'passed' ELSE 'failed' END, count_if(l_quantity >= 40) FROM lineitem UNION ALL SELECT 'open', 'unknown', 0""")
def status_checks(spark, sf_dir):
    q = F.col("l_quantity")
    return snapshots.checks(table(spark, sf_dir, "lineitem"), {"positive": q > 0, "small": q < 40, "open": F.lit(None).cast("boolean")})


@query("""WITH first AS (SELECT o_custkey, min(o_orderkey) AS root FROM orders GROUP BY o_custkey),
l AS (SELECT l_orderkey AS s, epoch_us(l_shipdate) * 1000 AS t_ns, row_number() OVER w AS seq, sum(l_quantity::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)),
ss AS (SELECT o_orderkey AS s, root, o_orderkey = root AS is_root, CASE WHEN o_orderkey = root THEN epoch_us(o_orderdate) * 1000 ELSE (SELECT min(t_ns) FROM l WHERE l.s = o_orderkey) END AS started FROM orders JOIN first USING (o_custkey)),
cut AS (SELECT root, max(t_ns) AS cutoff FROM l JOIN first ON s = root GROUP BY root),
m AS (SELECT ss.*, cutoff FROM ss JOIN cut USING (root) WHERE is_root OR started IS NULL OR started <= cutoff),
t AS (SELECT m.root, m.s, m.is_root, m.started, t_ns, seq, used % 100 AS input, used % 100 // 2 AS cached, used // 3 AS output, 0::BIGINT AS reasoning FROM l JOIN m USING (s) WHERE t_ns <= cutoff AND (started IS NULL OR t_ns >= started)),
f AS (SELECT *, coalesce(input < lag(input) OVER w OR cached < lag(cached) OVER w, false) AS fell FROM t WINDOW w AS (PARTITION BY root, s ORDER BY t_ns, seq)),
e AS (SELECT *, sum(fell::INT) OVER (PARTITION BY root, s ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM f),
p AS (SELECT root, s, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output FROM (SELECT root, s, epoch, max(input) AS i, max(output) AS o FROM e GROUP BY ALL) GROUP BY ALL),
b AS (SELECT root, s, max_by(input, (t_ns, seq)) AS input, max_by(output, (t_ns, seq)) AS output FROM e WHERE epoch = 0 AND NOT is_root AND t_ns <= started + 1000000000 GROUP BY ALL),
j AS (SELECT m.root, m.is_root, m.cutoff, m.started, p.input, p.output, coalesce(b.input, 0) AS bi, coalesce(b.output, 0) AS bo, b.s IS NOT NULL AS observed FROM m LEFT JOIN p USING (root, s) LEFT JOIN b USING (root, s))
SELECT root, count(*) AS members, CASE WHEN count(input) = count(*) THEN sum(input) END::BIGINT AS recorded_input, sum(bi)::BIGINT AS baseline_input,
  CASE WHEN count(input) = count(*) THEN sum(greatest(0, input - bi)) END::BIGINT AS unique_input, CASE WHEN count(output) = count(*) THEN sum(greatest(0, output - bo)) END::BIGINT AS unique_output,
  count_if(observed) AS observed_baselines, count_if(NOT is_root AND NOT observed) AS zero_baselines, max((cutoff - started) // 1000000) FILTER (is_root) AS wall_ms FROM j GROUP BY root""")
def tree_usage(spark, sf_dir):
    """A customer's first order is a task's root and the others its children, their lines the counters, which start again
    at every hundred."""
    orders, ns = table(spark, sf_dir, "orders"), lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    lines = table(spark, sf_dir, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    used = F.sum(F.col("l_quantity").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = lines.select(F.col("l_orderkey").alias("session_id"), ns("l_shipdate").alias("observed_ns"), F.row_number().over(own).alias("sequence"), used.alias("used"))
    tokens = told.select("session_id", "observed_ns", "sequence", (F.col("used") % 100).alias("input"), F.expr("used % 100 div 2").alias("cached"), F.expr("used div 3").alias("output"), F.lit(0).cast("long").alias("reasoning"))
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("root"))
    starts = told.groupBy(F.col("session_id").alias("o_orderkey")).agg(F.min("observed_ns").alias("first_ns"))
    is_root = F.col("o_orderkey") == F.col("root")
    sessions = orders.join(firsts, "o_custkey").join(starts, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("session_id"), F.when(~is_root, F.col("root")).alias("parent_id"), F.when(is_root, ns("o_orderdate")).otherwise(F.col("first_ns")).alias("started_ns"))
    roots = told.join(firsts.select(F.col("root").alias("session_id")), "session_id").groupBy(F.col("session_id").alias("root")).agg(F.max("observed_ns").alias("cutoff_ns"))
    found = tree.usage(sessions, tokens, told.select("session_id", "observed_ns"), roots)
    return found.select("root", "members", "recorded_input", "baseline_input", "unique_input", "unique_output", "observed_baselines", "zero_baselines", "wall_ms")
