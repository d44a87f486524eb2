"""Queries over calls: the lines of orders are commands, results and rejections of calls whose identities are used again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls
from ..sources import rollout
from .adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Returned lines are commands, open ones results (which may come first), and one in five of the rest a rejection.
_EVENTS = """e AS (SELECT l_suppkey, l_partkey % 7 AS call, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'intent' WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'rejection' ELSE 'result' END AS kind,
  l_partkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 7 ORDER BY epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) AS p, epoch_us(l_shipdate) AS t, l_returnflag AS flag FROM lineitem)"""


def _events(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "intent").when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), "rejection").otherwise("result")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_partkey") % 7).alias("call"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), "l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("flag"))
    return rows.withColumns({"intent": F.when(F.col("kind") == "intent", F.col("l_partkey")), "result": F.when(F.col("kind") == "result", F.col("q"))})


_KEYS, _PLACE = ["l_suppkey", "call"], ["t", "l_orderkey", "l_linenumber", "l_partkey", "q", "flag"]

# Independently of the operator: the head before a result is found by an as-of join.
_EXECUTIONS = f"""{_EVENTS}, h AS (SELECT *, row_number() OVER w AS generation, lead(kind) OVER w AS following FROM e WHERE kind <> 'result' WINDOW w AS (PARTITION BY l_suppkey, call ORDER BY p)),
r AS (SELECT h.l_suppkey, h.call, h.generation, max_by(r.q, r.p) AS result, count(*) AS results
  FROM (SELECT * FROM e WHERE kind = 'result') r ASOF JOIN h ON r.l_suppkey = h.l_suppkey AND r.call = h.call AND r.p >= h.p GROUP BY ALL),
x AS (SELECT h.*, r.result, coalesce(r.results, 0) AS results, coalesce(following = 'rejection', false) AS rejected FROM h LEFT JOIN r USING (l_suppkey, call, generation) WHERE h.kind = 'intent')"""


@query(f"WITH {_EXECUTIONS} SELECT l_suppkey, call, generation, t, l_orderkey, l_linenumber, l_partkey, q, flag, l_partkey AS intent, result, results, rejected FROM x")
def call_executions(spark, sf_dir):
    return calls.executions(_events(spark, sf_dir), _KEYS, _PLACE)


# An order is a call that several sources tell of; its lines are executions of one of three commands, of which one is no test.
_FOUND = """f AS (SELECT l_orderkey, CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END AS authority, l_suppkey::VARCHAR AS source, l_linenumber * 1000000 + l_partkey AS line, l_partkey % 3 AS h, l_partkey % 3 <> 2 AS is_test,
  CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'result_without_exit' ELSE 'intent_only' END AS completeness, CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT % 2 END AS exit_status,
  CASE WHEN l_returnflag <> 'A' THEN 'unknown' WHEN l_quantity::BIGINT % 2 = 0 THEN 'success' ELSE 'failed' END AS outcome,
  CASE WHEN l_returnflag <> 'A' THEN 'unknown' WHEN l_quantity::BIGINT % 2 = 0 THEN 'none' WHEN l_quantity % 3 = 0 THEN 'infra_failure' ELSE 'product_failure' END AS cause, epoch(l_shipdate)::BIGINT AS t FROM lineitem)"""


def _found(spark, sf_dir):
    q, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    done = flag == "A"
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("authority"), F.col("l_suppkey").cast("string").alias("source"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("line"),
        (F.col("l_partkey") % 3).alias("command_hash"), (F.col("l_partkey") % 3 != 2).alias("is_test"), F.lit("pytest").alias("runner"), F.lit("full").alias("scope"),
        F.when(done, "complete").when(flag == "N", "result_without_exit").otherwise("intent_only").alias("completeness"), F.when(done, q % 2).alias("exit_status"),
        F.when(~done, "unknown").when(q % 2 == 0, "success").otherwise("failed").alias("outcome"),
        F.when(~done, "unknown").when(q % 2 == 0, "none").when(q % 3 == 0, "infra_failure").otherwise("product_failure").alias("cause"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("observed_ns"), F.lit(None).cast("string").alias("turn_id"))


_RUNS = f"""{_FOUND}, top AS (SELECT l_orderkey, max(authority) AS authority FROM f GROUP BY ALL), said AS (SELECT l_orderkey, min(h) AS h, max_by(is_test, (source, line)) AS is_test FROM f JOIN top USING (l_orderkey, authority)
  GROUP BY l_orderkey HAVING min(h) = max(h)),
runs AS (SELECT l_orderkey, h, count(*) AS candidates, max({{'w': completeness = 'complete', 'e': completeness <> 'intent_only', 'a': authority, 's': source, 'l': line, 'x': exit_status, 'o': outcome, 'c': cause, 'm': completeness, 't': t}}) AS b
  FROM f JOIN said USING (l_orderkey, h) WHERE said.is_test AND f.is_test GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT l_orderkey, h AS command_hash, b.x AS exit_status, b.o AS outcome, b.c AS cause, b.m AS completeness, b.s AS source, b.l AS line, b.t AS observed_ns, candidates FROM runs WHERE b.e")
def canonical_test_runs(spark, sf_dir):
    return calls.canonical_runs(_found(spark, sf_dir), ["l_orderkey"]).drop("runner", "scope", "turn_id")


# Suppliers are sessions; commands repeat, and what was written between two runs of one decides what its success means.
_REPEATED = """r AS (SELECT l_suppkey, l_partkey % 4 AS h, CASE WHEN l_quantity <> 50 THEN epoch(l_shipdate)::BIGINT END AS t, l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount, l_tax < 0.04 AS good, l_discount < 0.03 AS infra, l_discount > 0.08 AS odd
  FROM lineitem WHERE l_returnflag <> 'R'),
w AS (SELECT DISTINCT l_suppkey, CASE WHEN l_quantity <> 50 THEN epoch(l_shipdate)::BIGINT END AS t, l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount FROM lineitem WHERE l_returnflag = 'R' OR l_quantity = 10),
o AS (SELECT *, CASE WHEN good THEN 'success' ELSE 'failed' END AS outcome, CASE WHEN good THEN 'none' WHEN infra THEN 'infra_failure' WHEN odd THEN 'unknown' ELSE 'product_failure' END AS cause,
  (coalesce(t, 9000000000000), l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount) AS p FROM r),
n AS (SELECT *, row_number() OVER v AS attempt, lag(outcome) OVER v AS b_outcome, lag(cause) OVER v AS b_cause, lag(p) OVER v AS b_p FROM o WINDOW v AS (PARTITION BY l_suppkey, h ORDER BY p))"""


@query(f"""WITH {_REPEATED} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, attempt, CASE WHEN outcome <> 'success' OR b_outcome IS NULL THEN 'none' WHEN b_cause = 'infra_failure' THEN 'infra_recovery'
  WHEN b_cause = 'product_failure' THEN CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.l_suppkey = n.l_suppkey AND (coalesce(w.t, 9000000000000), w.l_orderkey, w.l_linenumber, w.l_partkey, w.l_quantity, w.l_tax, w.l_discount) > n.b_p
    AND (coalesce(w.t, 9000000000000), w.l_orderkey, w.l_linenumber, w.l_partkey, w.l_quantity, w.l_tax, w.l_discount) < n.p) THEN 'product_fix_verification' ELSE 'flaky_retry' END
  WHEN b_outcome <> 'success' THEN 'unknown_recovery' ELSE 'none' END AS retry FROM n""")
def repeated_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    place = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount"]
    at = F.when(F.col("l_quantity") != 50, F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("t")
    good = F.col("l_tax") < 0.04
    cause = F.when(good, "none").when(F.col("l_discount") < 0.03, "infra_failure").when(F.col("l_discount") > 0.08, "unknown").otherwise("product_failure")
    runs = rows.where("l_returnflag <> 'R'").select("l_suppkey", (F.col("l_partkey") % 4).alias("h"), at, *place[1:], F.when(good, "success").otherwise("failed").alias("outcome"), cause.alias("cause"))
    writes = rows.where("l_returnflag = 'R' OR l_quantity = 10").select("l_suppkey", at, *place[1:])
    return calls.repeated(runs, writes, "l_suppkey", "h", place).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "attempt", "retry")


@query("""WITH x AS (SELECT l_orderkey, epoch(l_shipdate)::BIGINT * 1000000000 AS t, l_returnflag AS f, l_linestatus AS s, l_quantity::BIGINT AS q,
  (l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate)::BIGINT, l_quantity::BIGINT, l_returnflag, l_linestatus) AS p FROM lineitem),
g AS (SELECT l_orderkey, max(f) FILTER (f = 'A') AS a, max_by(s, p) FILTER (f = 'A') AS tool_a, max_by(s, p) FILTER (f <> 'A') AS tool_e,
  min(t) FILTER (f = 'A') AS started_ns, max_by(t, p) FILTER (f <> 'A') AS finished_ns, max_by(f, p) FILTER (f <> 'A') AS state,
  max_by(q, p) FILTER (f <> 'A' AND q > 40) AS told FROM x GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(tool_a, tool_e) AS tool, started_ns, finished_ns, coalesce(state, 'unknown') AS state,
  coalesce(told, CASE WHEN finished_ns >= started_ns THEN (finished_ns - started_ns) // 1000000 END) AS latency_ms, coalesce(finished_ns < started_ns, false) AS reversed FROM g""")
def call_spans(spark, sf_dir):
    start = F.col("l_returnflag") == "A"
    told = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(start, "start").otherwise("end").alias("kind"), F.col("l_linestatus").alias("tool"), F.lit("tool").alias("category"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1_000_000_000).alias("at_ns"), F.when(~start, F.col("l_returnflag")).alias("state"),
        F.when(~start & (F.col("l_quantity") > 40), F.col("l_quantity").cast("long")).alias("latency_ms"), F.lit(None).cast("string").alias("turn_id"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("flag"))
    return calls.spans(told, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "at_ns", "q", "flag", "tool"]).drop("category", "turn_id")


# Customers are files and their orders lines; what is known of them before lacks lines at the end, or has another one.
_FILES = """o AS (SELECT o_custkey % 97 AS path, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS ordinal, o_orderkey FROM orders),
old AS (SELECT path, ordinal, CASE WHEN path % 5 = 1 AND ordinal = 3 THEN 'x' ELSE o_orderkey::VARCHAR END AS f FROM o WHERE path % 5 <> 2 OR ordinal <= 40),
new AS (SELECT path, ordinal, o_orderkey::VARCHAR AS f FROM o WHERE path % 5 <> 3 OR ordinal <= 50)"""


@query(f"""WITH {_FILES}, a AS (SELECT path, count(*) AS n FROM old GROUP BY path), b AS (SELECT path, count(*) AS n FROM new GROUP BY path),
d AS (SELECT path, bool_or(old.f <> new.f) AS other FROM old JOIN new USING (path, ordinal) GROUP BY path)
SELECT path, a.n AS old_lines, b.n AS new_lines, CASE WHEN other THEN 'rewrite' WHEN a.n = b.n THEN 'exact' WHEN a.n < b.n THEN 'append' ELSE 'truncate' END AS relation FROM a JOIN b USING (path) JOIN d USING (path)""")
def file_relations(spark, sf_dir):
    from pyspark.sql import Window

    path = (F.col("o_custkey") % 97).alias("path")
    o = table(spark, sf_dir, "orders").select(path, "o_orderkey").withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")).cast("long"))
    rows = o.withColumn("fingerprint", F.col("o_orderkey").cast("string"))
    old = rows.where("path % 5 <> 2 OR ordinal <= 40").withColumn("fingerprint", F.when((F.col("path") % 5 == 1) & (F.col("ordinal") == 3), "x").otherwise(F.col("fingerprint")))
    return rollout.relations(old, rows.where("path % 5 <> 3 OR ordinal <= 50"))
