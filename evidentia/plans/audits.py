"""Queries over origins of sources, audits of reports, shapes and trend assessments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import render
from ..functions import shapes
from ..operators import audit, counters, origins, pilots
from .adapters import OBS, observations, table
from .texts import KEY, _hmac_sql

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


@query("""WITH l AS (SELECT o_custkey AS grp, o_orderkey AS src, l_returnflag AS x, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_returnflag) AS line
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT grp, src, count(*) AS n FROM l GROUP BY ALL),
p AS (SELECT a.grp, a.src AS source, b.src AS logical, least(na.n, nb.n) AS shared FROM n na JOIN n nb ON na.grp = nb.grp AND na.src % 2 = 1 AND nb.src % 2 = 0
  JOIN l a ON a.src = na.src JOIN l b ON b.src = nb.src AND b.line = a.line GROUP BY ALL, na.src, nb.src HAVING count(*) FILTER (a.x = b.x) = least(na.n, nb.n)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, source ORDER BY shared DESC, logical DESC) AS r FROM p)
SELECT grp, source, logical, shared FROM r WHERE r = 1""".replace("GROUP BY ALL, na.src, nb.src", "GROUP BY a.grp, a.src, b.src, na.n, nb.n"))
def prefix_lineage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("src"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), "l_linenumber", F.col("l_returnflag").alias("x"))
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("src").orderBy("l_linenumber", "x"))).join(orders, "src")
    odd = F.col("src") % 2 == 1
    known = numbered.where(~odd).select("grp", F.col("src").alias("logical"), "line", "x")
    return origins.prefix_lineage(known, numbered.where(odd).select("grp", F.col("src").alias("source"), "line", "x"), ["grp"], "line", "x")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS source, l_suppkey AS thread FROM lineitem),
s AS (SELECT DISTINCT s_suppkey AS thread, s_nationkey AS project, s_suppkey % 3 AS worktree FROM supplier WHERE s_acctbal > 0),
m AS (SELECT t.source, t.thread, s.project, s.worktree FROM t LEFT JOIN s USING (thread)),
g AS (SELECT source, bool_or(project IS NULL) AS lost, count(DISTINCT (project, worktree)) FILTER (project IS NOT NULL) AS places, min(project) AS project, min(worktree) AS worktree FROM m GROUP BY source),
r AS (SELECT s_nationkey AS project, s_suppkey % 3 AS worktree, count(DISTINCT s_suppkey % 2) AS roots FROM supplier GROUP BY ALL),
d AS (SELECT source, g.project, g.worktree, CASE WHEN lost THEN 'unavailable' WHEN places > 1 THEN 'ambiguous' WHEN roots IS NULL THEN 'unavailable' WHEN roots > 1 THEN 'ambiguous' END AS diagnostic
  FROM g LEFT JOIN r ON r.project = g.project AND r.worktree = g.worktree)
SELECT source, CASE WHEN diagnostic IS NULL THEN project END AS project, CASE WHEN diagnostic IS NULL THEN worktree END AS worktree, diagnostic FROM d""")
def worktree_attribution(spark, sf_dir):
    threads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("thread"))
    supplier = table(spark, sf_dir, "supplier")
    sessions = supplier.select(F.col("s_suppkey").alias("thread"), F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 3).alias("worktree"))
    trusted = supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("thread"), F.col("s_nationkey").alias("project"))
    roots = sessions.select("project", "worktree", (F.col("thread") % 2).alias("root"))
    return origins.worktrees(threads, sessions, trusted, roots)


_SHAPES = {
    0: ('{"b":1,"a":"x"}', "a:str,b:int"), 1: ('{"a":1.5,"n":null,"t":true}', "a:float,n:NoneType,t:bool"), 2: ('{"l":[1,2],"d":{"z":1}}', "d:dict,l:list"),
    3: ("[1,2]", None), 4: ('"text"', None), 5: ("17", None), 6: ("{}", ""), 7: ("{broken", None),
}


@query("WITH s AS (SELECT event_id % 8 AS m, count(*) AS n FROM events GROUP BY ALL) SELECT m, n, CASE m WHEN 3 THEN 'list' WHEN 4 THEN 'str' WHEN 5 THEN 'int' "
       + " ".join(f"WHEN {m} THEN 'shape/' || substr({_hmac_sql(f'''concat('diagnostic/', '{want}')''')}, 1, 32)" for m, (_, want) in _SHAPES.items() if want is not None) + " END AS shape FROM s")
def shape_fingerprint(spark, sf_dir):
    m = F.col("event_id") % 8
    given = F.coalesce(*[F.when(m == i, F.lit(json)) for i, (json, _) in _SHAPES.items()])
    rows = table(spark, sf_dir, "events").select(m.alias("m"), shapes.shape_fingerprint(given, KEY).alias("shape"))
    return rows.groupBy("m", "shape").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS}, e AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY at_us, event_id)::BIGINT AS epoch FROM (
  SELECT *, CASE WHEN amount < lag(amount) OVER (PARTITION BY user_id ORDER BY at_us, event_id) THEN 1 ELSE 0 END AS fell FROM obs)),
g AS (SELECT user_id, epoch, event_id, CASE WHEN event_id % 7 <> 0 THEN at_us END AS t, CASE WHEN event_id % 3 <> 0 THEN amount END AS amount, k FROM e),
v AS (SELECT user_id, epoch, max_by(amount, (t IS NULL, coalesce(t, 0), event_id)) FILTER (amount IS NOT NULL) AS amount, max_by(k, (t IS NULL, coalesce(t, 0), event_id)) FILTER (k IS NOT NULL) AS k,
  max(amount) AS ta, max(k) AS tk, bool_or(t IS NULL) AS ambiguous FROM g GROUP BY ALL)
SELECT user_id, epoch, amount, k, coalesce(CASE WHEN ambiguous THEN ta ELSE amount END, 0)::BIGINT AS least_amount, coalesce(CASE WHEN ambiguous THEN tk ELSE k END, 0)::BIGINT AS least_k, ambiguous FROM v""")
def epoch_vectors(spark, sf_dir):
    rows = counters.with_epochs(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], ["amount"])
    gaps = rows.withColumns({"amount": F.when(F.col("event_id") % 3 != 0, F.col("amount")), "at_us": F.when(F.col("event_id") % 7 != 0, F.col("at_us"))})
    return counters.epoch_vectors(gaps, ["user_id"], "at_us", ["event_id"], ["amount", "k"])


_TASKS = """t AS (SELECT c_nationkey AS family, o_orderkey AS ref, epoch_us(o_orderdate) AS at_us, round(o_totalprice * 100)::BIGINT AS working, n AS retries, r AS reads
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
  WHERE o_orderstatus <> 'P')"""


def _tasks(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ref")).agg(F.count(F.lit(1)).alias("retries"), F.count_if(F.col("l_returnflag") == "R").alias("reads"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("family"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("ref"), _us("o_orderdate").alias("at_us"), F.round(F.col("o_totalprice") * 100).cast("long").alias("working"))
    return orders.join(customers, "o_custkey").join(per, "ref").select("family", "ref", "at_us", "working", "retries", "reads")


@query(f"""WITH {_TASKS}, p AS (SELECT a.family, a.ref, b.working AS w, b.retries AS x, b.reads AS y, row_number() OVER (PARTITION BY a.family, a.ref ORDER BY b.at_us DESC, b.ref DESC) AS r
  FROM t a JOIN t b ON b.family = a.family AND b.at_us < a.at_us),
l AS (SELECT family, ref, list_sort(list(w)) AS w, list_sort(list(x)) AS x, list_sort(list(y)) AS y FROM p WHERE r <= 4 GROUP BY ALL HAVING count(*) = 4),
j AS (SELECT t.*, w[2] + w[3] AS baseline2, CASE WHEN 2 * retries > x[2] + x[3] THEN 'retries' WHEN 2 * reads > y[2] + y[3] THEN 'reads' END AS s FROM t LEFT JOIN l USING (family, ref))
SELECT family, ref, at_us, working, retries, reads, baseline2, CASE WHEN 2 * working > baseline2 THEN s END AS signal, coalesce(2 * working > baseline2, false) AND s IS NOT NULL AS warning,
  CASE WHEN baseline2 IS NULL THEN 'too_few_tasks' WHEN 2 * working > baseline2 AND s IS NULL THEN 'no_corroborating_signal' END AS caveat FROM j""")
def trend_assessment(spark, sf_dir):
    return audit.assess(_tasks(spark, sf_dir), ["family"], "at_us", "ref", "working", ["retries", "reads"])


@query("""WITH a AS (SELECT o_orderkey AS task, o_orderstatus AS status, o_custkey AS family, o_orderkey % 10 AS conflicts FROM orders WHERE o_orderkey % 9 <> 0),
r AS (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey AS family, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS conflicts FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT coalesce(a.task, r.task) AS task, a.task IS NULL OR r.task IS NULL AS missing, a.status <> r.status AS s, a.family <> r.family AS f, r.conflicts IS NOT NULL AND a.conflicts <> r.conflicts AS c FROM a FULL JOIN r ON r.task = a.task)
SELECT task, 'missing' AS field FROM b WHERE missing UNION ALL SELECT task, 'status' FROM b WHERE s UNION ALL SELECT task, 'family' FROM b WHERE f UNION ALL SELECT task, 'conflicts' FROM b WHERE c""")
def task_coherence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("family"))
    k = F.col("task")
    audited = orders.where(k % 9 != 0).withColumn("conflicts", k % 10)
    reported = orders.where(k % 7 != 0).withColumns({"status": F.when(k % 4 == 0, "X").otherwise(F.col("status")), "conflicts": F.when(k % 2 == 0, k % 5)})
    return audit.disagreements(audited, reported, "task", ["status", "family"], ["conflicts"])


@query("""WITH i AS (SELECT c_nationkey AS project, count(*) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' GROUP BY ALL),
a AS (SELECT c_nationkey AS project, sum(n)::BIGINT AS attributed, count(*) AS tasks FROM customer JOIN (
  SELECT o_custkey, sum(o_orderkey % 3 + 1)::BIGINT AS n FROM orders WHERE starts_with(o_orderpriority, '1') GROUP BY o_custkey) d ON o_custkey = c_custkey GROUP BY ALL)
SELECT coalesce(i.project, a.project) AS project, coalesce(total, 0)::BIGINT AS total, coalesce(attributed, 0)::BIGINT AS attributed, coalesce(tasks, 0)::BIGINT AS tasks FROM i FULL JOIN a ON a.project = i.project""")
def issue_counts(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("project"))
    orders = table(spark, sf_dir, "orders")
    sources = orders.select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("task")).join(tasks, "task")
    issues = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source"))
    found = orders.select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("code"), (F.col("o_orderkey") % 3 + 1).cast("long").alias("n"))
    return audit.issue_counts(issues, sources, found, tasks, "1")


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders WHERE o_orderkey % 20 <> 0 AND o_custkey % 5 <> 0 GROUP BY o_custkey)
SELECT n.k AS o_custkey, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM n LEFT JOIN s ON s.k = n.k WHERE s.k IS NULL OR s.n <> n.n OR s.a <> n.a OR s.b <> n.b""")
def stats_validation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = audit.stats(orders.where("o_orderkey % 20 <> 0 AND o_custkey % 5 <> 0"), "o_custkey", "o_orderdate")
    return audit.stale_stats(kept, orders, "o_custkey", "o_orderdate")


@query("""WITH n AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS audit FROM orders GROUP BY o_custkey)
SELECT o_custkey, audit, l_linenumber, l_partkey FROM n JOIN lineitem ON l_orderkey = audit WHERE l_returnflag = 'A'""")
def evidence_lookup(spark, sf_dir):
    audits = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("audit"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("audit"), "l_linenumber", "l_partkey", "l_returnflag")
    return audit.in_newest(audits, lines, "o_custkey", "audit", "o_orderdate", F.col("l_returnflag") == "A").select("o_custkey", "audit", "l_linenumber", "l_partkey")


@query(f"""WITH {_TASKS} SELECT ref, to_json({{'task': ref, 'family': family, 'tokens': {{'working': working, 'reads': reads}}, 'retries': {{'value': retries, 'provenance': CASE WHEN reads > 0 THEN 'derived' ELSE 'estimated' END}}}})::VARCHAR AS report FROM t""")
def task_report_tree(spark, sf_dir):
    made = _tasks(spark, sf_dir).select(
        "ref", F.col("ref").alias("task"), "family", F.struct("working", "reads").alias("tokens"),
        F.struct(F.col("retries").alias("value"), F.when(F.col("reads") > 0, "derived").otherwise("estimated").alias("provenance")).alias("retries"))
    return audit.public(made).select("ref", render.as_json("task", "family", "tokens", "retries").alias("report"))


@query("""WITH q AS (SELECT c_nationkey AS project, o_orderkey AS request, o_orderkey % 3 AS target, o_orderstatus AS family FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT n_nationkey AS project, 1 AS target, 'F' AS family FROM nation WHERE n_nationkey % 2 = 0), f AS (SELECT project, min_by((target, family), request) AS b, min(request) AS request FROM q WHERE target >= 1 GROUP BY project)
SELECT q.project, q.request, CASE WHEN q.target < 1 THEN 'invalid' WHEN p.project IS NULL AND q.request = f.request THEN 'started'
  WHEN (p.project IS NOT NULL AND q.target = p.target AND q.family = p.family) OR (p.project IS NULL AND (q.target, q.family) = f.b) THEN 'resumed' ELSE 'refused' END AS outcome
FROM q LEFT JOIN p ON p.project = q.project LEFT JOIN f ON f.project = q.project""")
def pilot_start(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project"))
    asked = table(spark, sf_dir, "orders").join(customers, "o_custkey").select("project", F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 3).alias("target"), F.col("o_orderstatus").alias("family"))
    runs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("project"), F.lit(1).cast("long").alias("target"), F.lit("F").alias("family"), F.when(F.col("n_nationkey") % 2 == 0, "open").otherwise("closed").alias("state"))
    return pilots.started(runs, asked, "request").select("project", "request", "outcome")
