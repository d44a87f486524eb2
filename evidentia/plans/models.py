"""Queries over canonical evidence and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import render
from ..operators import evidence
from .adapters import OBS, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


_LINES = """c AS (SELECT l_orderkey, CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END AS auth, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity > 25 AS done,
  'q' || l_quantity::BIGINT AS outcome, epoch_us(l_shipdate) AS t FROM lineitem)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("auth"), "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") > 25).alias("done"),
        F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string")).alias("outcome"), _us("l_shipdate").alias("t"))


@query(f"""WITH {_LINES} SELECT l_orderkey, max_by(l_partkey, (auth, l_linenumber, l_partkey, l_suppkey, outcome)) AS description,
  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS content,
  coalesce(max_by(outcome, (auth, l_linenumber, l_partkey, l_suppkey, outcome)) FILTER (done), 'unknown') AS outcome, count(*) AS candidates FROM c GROUP BY l_orderkey""")
def test_evidence_canonical(spark, sf_dir):
    return evidence.canonical_tests(_lines(spark, sf_dir), ["l_orderkey"], "auth", "l_partkey", "l_returnflag", "outcome", "done", ["l_linenumber", "l_partkey", "l_suppkey", "outcome"])


@query(f"""WITH {_LINES}, g AS (SELECT l_orderkey, min_by(l_suppkey, (-auth, l_suppkey, NOT done)) AS owner, min_by(done, (-auth, l_suppkey, NOT done)) AS ok,
  min(t) FILTER (done) AS observed_at, count(*) AS told FROM c GROUP BY l_orderkey) SELECT l_orderkey, owner, observed_at, told FROM g WHERE ok""")
def file_observation_canonical(spark, sf_dir):
    return evidence.canonical_files(_lines(spark, sf_dir), ["l_orderkey"], "l_suppkey", "auth", "done", "t")


@query("""WITH i AS (SELECT o_orderkey AS k, max_by(o_orderstatus, o_orderdate) AS intent FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderkey),
r AS (SELECT l_orderkey AS k, max_by(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS result FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT coalesce(i.k, r.k) AS k, intent, result, CASE WHEN intent IS NULL THEN 'result_only' WHEN result IS NULL THEN 'intent_only' ELSE 'complete' END AS kind FROM i FULL JOIN r ON i.k = r.k""")
def intent_result_join(spark, sf_dir):
    intents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.struct("o_orderdate").alias("t"), F.col("o_orderstatus").alias("intent"))
    results = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("k"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("t"), F.col("l_returnflag").alias("result"))
    return evidence.call_results(intents, results, ["k"], "t")


@query("""SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey OR s_suppkey = l_partkey""")
def either_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return evidence.either_key(lines, table(spark, sf_dir, "supplier").select("s_suppkey"), ["l_suppkey", "l_partkey"], "s_suppkey")


@query(f"""WITH {OBS}, s AS (SELECT user_id, event_id AS arrival, at_us % 1000 AS seq, k AS ident, amount FROM obs),
e AS (SELECT *, coalesce(CASE WHEN amount % 13 = 0 THEN 'malformed' WHEN amount % 11 = 0 THEN 'expired' WHEN amount % 7 = 0 THEN 'wrong_capability' END,
  CASE WHEN row_number() OVER (PARTITION BY user_id * 1000 + ident ORDER BY arrival) > 1 THEN 'duplicate' END) AS early FROM s),
t AS (SELECT *, max(CASE WHEN early IS NULL THEN seq END) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT arrival, coalesce(early, CASE WHEN seq <= top THEN 'out_of_order' END, 'accepted') AS category FROM t""")
def spool_quarantine(spark, sf_dir):
    staged = observations(spark, sf_dir).select("user_id", F.col("event_id").alias("_arrival"), (F.col("at_us") % 1000).alias("seq"), (F.col("user_id") * 1000 + F.col("k")).alias("ident"), "amount")
    a = F.col("amount")
    return evidence.quarantine(staged, ["user_id"], "seq", "ident", expired=a % 11 == 0, wrong=a % 7 == 0, malformed=a % 13 == 0).select(F.col("_arrival").alias("arrival"), "category")


@query("""WITH t AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS fam, o_totalprice > 200000 AS x FROM orders),
c AS (SELECT o_custkey, fam, count(*) FILTER (NOT x AND fam IS NOT NULL) AS n, count(*) AS a FROM t GROUP BY ALL),
b AS (SELECT o_custkey, max(n) AS largest_family, sum(a)::BIGINT AS tasks FROM c GROUP BY o_custkey)
SELECT *, largest_family >= 2 AS ready, CASE WHEN tasks < 2 THEN 'too_few_tasks' WHEN largest_family < 2 THEN 'no_common_family' ELSE 'none' END AS reason FROM b""")
def comparability(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("fam"), "o_totalprice")
    return evidence.readiness(tasks, ["o_custkey"], "fam", F.col("o_totalprice") > 200000)


@query("""SELECT o_custkey, max_by(o_orderpriority, (o_orderstatus = 'F', o_orderdate, o_orderpriority)) AS name, epoch_us(max(o_orderdate)) AS last_seen FROM orders GROUP BY o_custkey""")
def catalog_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").alias("config"), _us("o_orderdate").alias("at_us"))
    return evidence.upsert_catalog(rows, "o_custkey", "name", "config", "at_us")


@query("""WITH t AS (SELECT c_nationkey, o_orderkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS r
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_nationkey, count(*) AS tasks, sum(cents)::BIGINT AS amount, array_to_string(list(o_orderkey ORDER BY r) FILTER (r <= 10), ',') AS recent, max(o_orderkey) FILTER (r = 1) AS latest FROM t GROUP BY c_nationkey""")
def project_overview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rows = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return evidence.overview(rows, ["c_nationkey"], "o_orderdate", "o_orderkey", "cents").withColumn("recent", F.array_join(F.col("recent").cast("array<string>"), ","))


@query("""SELECT o_orderstatus AS state, count(*) AS n, count(DISTINCT o_custkey) AS owners, count(*) FILTER (o_orderkey > 7500) AS grown FROM orders GROUP BY o_orderstatus""")
def state_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("owners"), F.count_if(F.col("o_orderkey") > 7500).alias("grown"))


@query("""SELECT c_mktsegment, count(*) AS directories, count(o.k) AS visited, sum(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS remaining
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON o.k = c_custkey GROUP BY c_mktsegment""")
def frontier_progress(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_v", F.lit(True))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(done, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("directories"), F.count("_v").alias("visited"), F.count_if(F.col("_v").isNull()).alias("remaining"))


@query("""SELECT o_custkey, to_json({'task': o_custkey, 'orders': count(*), 'status': max(o_orderstatus)})::VARCHAR AS report FROM orders GROUP BY o_custkey""")
def report_json(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("status"))
    return rows.select("o_custkey", render.as_json(F.col("o_custkey").alias("task"), "orders", "status").alias("report"))
