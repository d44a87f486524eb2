"""Queries over lineage, arbitration, reports, cohorts and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arbitration, facts, lineage
from .adapters import OBS, observations, table

QUERIES, ORACLES = {}, {}
RANKS = {"purchase": 3, "view": 2, "click": 1}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query(f"""WITH {OBS}, r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END::BIGINT AS rank FROM obs)
SELECT user_id, event_id, rank, rank = max(rank) OVER (PARTITION BY user_id) AS contributes FROM r""")
def source_selection(spark, sf_dir):
    obs = observations(spark, sf_dir).select("user_id", "event_id", "event_type")
    return arbitration.select_source(obs, ["user_id"], arbitration.authority(F.col("event_type"), RANKS)).select("user_id", "event_id", "rank", "contributes")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_quantity::BIGINT AS quantity, epoch_us(l_shipdate) AS ship, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, max_by(l_suppkey, (l_linestatus, l_linenumber, l_partkey, l_suppkey)) AS descriptor, min(ship) AS started,
  max_by(l_returnflag, (ship, l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS terminal, max(quantity) AS latency, count(*) AS candidates FROM c GROUP BY l_orderkey""")
def span_fieldwise_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"), _us("l_shipdate").alias("ship"), "l_partkey", "l_suppkey")
    return arbitration.merge_fields(rows, ["l_orderkey"], {
        "descriptor": ("l_suppkey", "max", ["l_linestatus", "l_linenumber", "l_partkey", "l_suppkey"]), "started": ("ship", "min", ["ship", "l_linenumber"]),
        "terminal": ("l_returnflag", "max", ["ship", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]), "latency": ("quantity", "max", ["quantity", "l_linenumber"])})


@query("""WITH c AS (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_quantity >= 47 THEN 'confirmed' WHEN l_quantity <= 1 THEN 'ambiguous' ELSE 'inferred' END AS kind FROM lineitem),
g AS (SELECT l_partkey, count(DISTINCT CASE WHEN kind = 'confirmed' THEN l_suppkey END) AS nc, min(CASE WHEN kind = 'confirmed' THEN l_suppkey END) AS c,
  count(DISTINCT CASE WHEN kind = 'inferred' THEN l_suppkey END) AS ni, min(CASE WHEN kind = 'inferred' THEN l_suppkey END) AS i, bool_or(kind = 'ambiguous') AS a FROM c GROUP BY l_partkey),
s AS (SELECT *, CASE WHEN a OR nc > 1 THEN 'ambiguous' WHEN nc = 1 THEN 'confirmed' WHEN ni = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence_kind FROM g)
SELECT l_partkey, CASE confidence_kind WHEN 'confirmed' THEN c WHEN 'inferred' THEN i END AS parent, confidence_kind,
  (CASE confidence_kind WHEN 'confirmed' THEN 1.0 WHEN 'inferred' THEN 0.6 ELSE 0.0 END)::DOUBLE AS confidence FROM s""")
def lineage_claims_whole(spark, sf_dir):
    """Every lineitem row is a claim."""
    kind = F.when(F.col("l_quantity") >= 47, "confirmed").when(F.col("l_quantity") <= 1, "ambiguous").otherwise("inferred").alias("kind")
    return arbitration.resolve_parents(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", kind), "l_partkey", "l_suppkey", "kind")


_FOREST = """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 AND p_size % 3 <> 0 THEN p_partkey // 2 END AS parent FROM part),
r AS (SELECT node, node AS root FROM n WHERE parent IS NULL UNION ALL SELECT n.node, r.root FROM n JOIN r ON n.parent = r.node)"""


def _forest(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when((F.col("p_partkey") > 1) & (F.col("p_size") % 3 != 0), F.floor(F.col("p_partkey") / 2)).alias("parent"))


@query(_FOREST + " SELECT node, root FROM r")
def forest_roots(spark, sf_dir):
    return lineage.roots(_forest(spark, sf_dir), "node", "parent")


@query("""WITH RECURSIVE c AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM c JOIN part ON p_partkey // 2 = node AND p_partkey > 1 WHERE p_size <= 45)
SELECT node, depth FROM c""")
def descendant_closure(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), "p_size")
    start = parts.where("node = 1").select(F.col("node").alias("root"))
    return lineage.descendants(parts, "node", "parent", start, F.col("p_size") <= 45).select("node", "depth")


@query(_FOREST + """, f AS (SELECT root, l_quantity::BIGINT AS q, l_suppkey, epoch_us(l_shipdate) AS t FROM r JOIN lineitem ON l_partkey = node WHERE l_shipdate <= TIMESTAMP '1998-09-02'),
s AS (SELECT root, count(*) AS facts, sum(q)::BIGINT AS amount, count(DISTINCT l_suppkey) AS observers, min(t) AS first_at, max(t) AS last_at FROM f GROUP BY root)
SELECT m.root, m.members, coalesce(facts, 0)::BIGINT AS facts, amount, coalesce(observers, 0)::BIGINT AS observers, first_at, last_at, (last_at - first_at) // 1000 AS elapsed_ms
FROM (SELECT root, count(*) AS members FROM r GROUP BY root) m LEFT JOIN s ON s.root = m.root""")
def task_tree_rollup(spark, sf_dir):
    members = lineage.roots(_forest(spark, sf_dir), "node", "parent")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_suppkey", "l_shipdate", _us("l_shipdate").alias("t"))
    return lineage.rollup(members, rows, "l_partkey", "q", "l_suppkey", "t", F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))


@query("""SELECT o_custkey, max_by(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderpriority, o_orderdate, o_orderkey)) AS o_orderstatus
FROM orders GROUP BY o_custkey""")
def lifecycle_boundary(spark, sf_dir):
    return arbitration.boundary(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate")], ["o_orderkey", "o_orderstatus"])


@query("""WITH e AS (SELECT l_orderkey, date_trunc('month', l_shipdate) AS m, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS fam, l_linenumber, l_quantity::BIGINT AS d FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, m, fam ORDER BY l_linenumber, d) AS i FROM e)
SELECT l_orderkey, epoch_us(m) AS m, max(fam)::BIGINT AS fam, CASE WHEN min(d) = max(d) THEN min(d) END AS d, count(*) AS told FROM i GROUP BY l_orderkey, m, i""")
def lifecycle_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.unix_micros(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("m"), F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1).cast("long").alias("fam"),
        "l_linenumber", F.col("l_quantity").cast("long").alias("d"))
    return arbitration.zip_families(rows, ["l_orderkey"], "m", "fam", ["l_linenumber", "d"], "d")


_MONTHLY = """WITH r AS (SELECT c_nationkey AS nation, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS month, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS revenue
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _monthly(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month"), _cents("o_totalprice").alias("cents"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return orders.join(customers, "o_custkey").groupBy("nation", "month").agg(F.sum("cents").alias("revenue"))


@query(_MONTHLY + """, l AS (SELECT *, list(revenue) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT nation, month, revenue, CASE WHEN len(p) = 4 THEN list_sort(p)[2] + list_sort(p)[3] END AS twice_median,
  coalesce(len(p) = 4 AND 2 * revenue > list_sort(p)[2] + list_sort(p)[3], false) AS warning FROM l""")
def trend_window(spark, sf_dir):
    return facts.trend(_monthly(spark, sf_dir), ["nation"], "month", "revenue")


@query(_MONTHLY + """, f AS (SELECT nation, 'revenue' AS metric, month, revenue AS v FROM r UNION ALL SELECT nation, 'months_over_mean', month, CASE WHEN revenue > 200000000 THEN 1 ELSE 0 END FROM r),
g AS (SELECT nation, metric, sum(v) FILTER (month BETWEEN 23941 AND 23952)::BIGINT AS baseline, sum(v) FILTER (month BETWEEN 23953 AND 23964)::BIGINT AS current FROM f GROUP BY ALL)
SELECT nation, metric, baseline, current, current - baseline AS delta, CASE WHEN baseline <> 0 THEN trunc((current - baseline) * 10000::DOUBLE / baseline)::BIGINT END AS change_bp,
  CASE WHEN baseline IS NULL OR current IS NULL THEN 'unknown' WHEN baseline = 0 THEN 'partial' ELSE 'comparable' END AS verdict FROM g WHERE baseline IS NOT NULL OR current IS NOT NULL""")
def pairwise_compare(spark, sf_dir):
    r = _monthly(spark, sf_dir)
    side = F.when(F.col("month").between(23941, 23952), "baseline").when(F.col("month").between(23953, 23964), "current")
    over = F.when(F.col("revenue") > 200000000, 1).otherwise(0).cast("long")
    long_form = r.withColumn("side", side).where("side IS NOT NULL").groupBy("nation", "side").agg(F.sum("revenue").alias("revenue"), F.sum(over).alias("months_over_mean"))
    rows = long_form.unpivot(["nation", "side"], ["revenue", "months_over_mean"], "metric", "value")
    return facts.compare(rows, ["nation"], "metric", "side", "value")


@query("""WITH o AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
j AS (SELECT c_nationkey, v FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_nationkey, CASE WHEN count(*) = count(v) THEN sum(v) END::BIGINT AS value, coalesce(sum(v), 0)::BIGINT AS lower_bound,
  CASE WHEN count(*) = count(v) THEN 'derived' ELSE 'estimated' END AS provenance, CASE WHEN count(*) = count(v) THEN '' ELSE 'aggregate_component_unavailable' END AS caveats FROM j GROUP BY c_nationkey""")
def null_guarded_sum(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(_cents("o_totalprice")).alias("v"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(totals, "c_custkey", "left")
    return facts.sum_facts(rows, ["c_nationkey"], "v").withColumn("caveats", F.array_join("caveats", ","))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey),
g AS (SELECT c_mktsegment, count(*) AS customers, count(n) AS active, coalesce(sum(n), 0)::BIGINT AS orders, coalesce(sum(f), 0)::BIGINT AS finished FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT *, active * 100 >= 60 * customers AS enough_active, finished * 100 >= 40 * orders AS enough_finished, active * 100 >= 60 * customers AND finished * 100 >= 40 * orders AS passed FROM g""")
def cohort_thresholds(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(per, "c_custkey", "left")
    zero = F.lit(0).cast("long")
    cohort = rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("n").alias("active"), F.coalesce(F.sum("n"), zero).alias("orders"), F.coalesce(F.sum("f"), zero).alias("finished"))
    return facts.thresholds(cohort, {"enough_active": F.col("active") * 100 >= 60 * F.col("customers"), "enough_finished": F.col("finished") * 100 >= 40 * F.col("orders")})


@query(f"""WITH {OBS}, g AS (SELECT *, (at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id)) // 1000 AS ms FROM obs WHERE at_us <= 1705276800000000)
SELECT user_id, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS failed, quantile_disc(ms, 0.95)::BIGINT AS p95_ms, max(ms) AS max_ms FROM g GROUP BY user_id""")
def latency_transport(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    rows = observations(spark, sf_dir).where("at_us <= 1705276800000000").withColumn("ms", F.floor((F.col("at_us") - F.lag("at_us").over(w)) / 1000))
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("accepted"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("long").alias("p95_ms"), F.max("ms").alias("max_ms"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate) AS at_us FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-15' OR (o_orderdate = TIMESTAMP '1997-06-15' AND o_orderkey > 5000)
ORDER BY o_orderdate DESC, o_orderkey LIMIT 51""")
def keyset_page(spark, sf_dir):
    import datetime

    rows = table(spark, sf_dir, "orders").select("o_orderkey", _us("o_orderdate").alias("at_us"))
    at = int(datetime.datetime(1997, 6, 15, tzinfo=datetime.UTC).timestamp()) * 1_000_000
    return facts.page(rows, "at_us", "o_orderkey", 50, (at, 5000))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders) l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.o_orderkey AND o.o_custkey = l.o_custkey AND o.o_orderstatus = l.s AND o.o_totalprice = l.p AND o.o_orderkey % 11 <> 0)""")
def unchanged_skip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    listing = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return arbitration.unchanged(listing, orders.where("o_orderkey % 11 <> 0"), orders.columns).select("o_orderkey")


@query("""WITH k AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderdate < '1998-01-01'),
a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders)
SELECT a.o_orderkey, CASE WHEN k.o_orderkey IS NULL THEN 'inserted' WHEN k.o_orderstatus = a.o_orderstatus AND k.o_custkey = a.o_custkey THEN 'duplicate' ELSE 'conflicting' END AS outcome
FROM a LEFT JOIN k ON a.o_orderkey = k.o_orderkey""")
def idempotent_insert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate", "o_orderpriority")
    arriving = orders.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "Z").otherwise(F.col("o_orderstatus")))
    return arbitration.split_inserts(orders.where("o_orderdate < '1998-01-01'"), arriving, "o_orderkey", ["o_orderstatus", "o_custkey"]).select("o_orderkey", "outcome")


@query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def having_unique(spark, sf_dir):
    return arbitration.only_value(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""SELECT custkey, min(t) AS first_at, max(t) AS last_at, count(*) AS n FROM (SELECT o_custkey AS custkey, epoch_us(o_orderdate) AS t FROM orders
UNION ALL SELECT o_custkey, epoch_us(l_shipdate) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY custkey""")
def activity_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ordered = orders.select(F.col("o_custkey").alias("custkey"), _us("o_orderdate").alias("t"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _us("l_shipdate").alias("t")).join(orders.select("o_orderkey", F.col("o_custkey").alias("custkey")), "o_orderkey").select("custkey", "t")
    return ordered.unionByName(shipped).groupBy("custkey").agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS key, c_nationkey AS nation, 'customer' AS origin FROM customer WHERE c_acctbal > 9900
UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def catalog_union_anti(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("origin"))
    return catalog.unionByName(more.join(catalog.select("nation").distinct(), "nation", "left_anti"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') THEN 'repair_required'
  WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'queued' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'reconcile_required' ELSE 'current' END AS freshness FROM customer""")
def pending_set(spark, sf_dir):
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("repair"), F.bool_or(F.col("o_orderstatus") == "O").alias("queued"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(state, "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("repair"), "repair_required").when(F.col("queued"), "queued").when(F.col("repair").isNotNull(), "reconcile_required").otherwise("current").alias("freshness"))


@query("""SELECT 'orders' AS tbl, count(*) AS n, sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 8))::BIGINT)::BIGINT AS digest FROM orders
UNION ALL SELECT 'customer', count(*), sum(('0x' || substr(md5(c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_mktsegment), 1, 8))::BIGINT)::BIGINT FROM customer""")
def content_digest(spark, sf_dir):
    def digest(name, columns):
        line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
        part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
        return table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest")).select(F.lit(name).alias("tbl"), "n", "digest")

    return digest("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).unionByName(digest("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01'), p AS (SELECT p_partkey AS k FROM part WHERE p_size > 10)
SELECT k, 'dangling' AS problem FROM l WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, 'orphan' FROM p WHERE k NOT IN (SELECT k FROM l)""")
def audit_closure(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1995-03-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("k"))
    return facts.dangling(refs, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), "k")


@query("""SELECT code, count(*) AS n FROM (SELECT 'missing_balance' AS code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'open_order' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'returned' FROM lineitem WHERE l_returnflag = 'R') GROUP BY code""")
def diagnostic_counts(spark, sf_dir):
    found = [("customer", "c_acctbal < 0", "missing_balance"), ("orders", "o_orderstatus = 'O'", "open_order"), ("lineitem", "l_returnflag = 'R'", "returned")]
    rows = [table(spark, sf_dir, t).where(c).select(F.lit(code).alias("code")) for t, c, code in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


QUERIES["lineage_claims"], ORACLES["lineage_claims"] = QUERIES["lineage_claims_whole"], ORACLES["lineage_claims_whole"]
