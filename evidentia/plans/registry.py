"""Queries over canonical reports, their facts, and messages that tell one identity in two places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import pilots, registry
from ..sources import exports
from .adapters import OBS, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _reports(spark, sf_dir):
    """A report per customer: totals, its orders in order, and the lines of each by their status."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    by_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(by_order, "o_orderkey", "left").select(
        "o_custkey", F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "lines").alias("o"))
    listed = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("o"), lambda a, b: F.when(a["o_orderkey"] < b["o_orderkey"], -1).when(a["o_orderkey"] > b["o_orderkey"], 1).otherwise(0)).alias("orders"))
    return listed.select(F.col("o_custkey").alias("task"), F.struct(F.struct(F.col("n").alias("orders"), F.lit("né\"e").alias("note")).alias("totals"), "orders").alias("report"))


# The same as text, put together by hand; a price has no zeros at its end.
_ORDERS = """ln AS (SELECT l_orderkey AS k, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL),
lt AS (SELECT k, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS lines FROM ln GROUP BY k),
o AS (SELECT o_custkey AS task, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, regexp_replace(regexp_replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '0+$', ''), '\\.$', '') AS price,
  CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END AS status, lines FROM orders LEFT JOIN lt ON k = o_orderkey)"""
_REPORTS = f"""{_ORDERS}, r AS (SELECT task, '{{"orders":[' || string_agg('{{"lines":' || coalesce(lines, 'null') || ',"o_orderkey":' || o_orderkey || ',"price":' || price || ',"status":' || status || '}}', ',' ORDER BY i)
  || '],"totals":{{"note":"né\\"e","orders":' || count(*) || '}}}}' AS text FROM o GROUP BY task)"""


@query(f"WITH {_REPORTS} SELECT task, text, sha256(text) AS digest FROM r".replace("\\\\.", "\\.").replace('né\\"e', 'né\\"e'))
def report_digests(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    kind = reports.schema["report"].dataType
    return reports.select("task", canonical.canonical(F.col("report"), kind).alias("text"), canonical.digest(F.col("report"), kind).alias("digest"))


_FACTS = f"""{_ORDERS}, f AS (
  SELECT DISTINCT task, '/totals/note' AS path, '"né\\"e"' AS value FROM o UNION ALL SELECT task, '/totals/orders', count(*)::VARCHAR FROM o GROUP BY task
  UNION ALL SELECT task, '/orders/' || i || '/o_orderkey', o_orderkey::VARCHAR FROM o UNION ALL SELECT task, '/orders/' || i || '/price', price FROM o UNION ALL SELECT task, '/orders/' || i || '/status', status FROM o
  UNION ALL SELECT task, '/orders/' || i || '/lines/' || s, n::VARCHAR FROM o JOIN ln ON k = o_orderkey UNION ALL SELECT task, '/orders/' || i || '/lines', 'null' FROM o WHERE lines IS NULL),
reg AS (SELECT *, 'ev_' || substr(sha256(task || chr(31) || path || chr(31) || value), 1, 16) AS evidence_id FROM f)"""


@query(f"WITH {_FACTS} SELECT * FROM reg".replace("\\\\.", "\\."))
def evidence_registry(spark, sf_dir):
    return registry.registered(_reports(spark, sf_dir), "task", "report")


_VIEWS = f"""{_FACTS}, ref AS (SELECT DISTINCT task, CASE WHEN task % 9 = 2 AND path LIKE '%price' THEN evidence_id || 'x' ELSE evidence_id END AS evidence_id FROM reg WHERE NOT (task % 7 = 3 AND path LIKE '%status'))"""


@query(f"""WITH {_VIEWS}, p AS (SELECT task, count(*) FILTER (reg.e IS NULL) AS dangling, count(*) FILTER (ref.e IS NULL) AS orphan FROM (SELECT task, evidence_id AS e FROM reg) reg FULL JOIN (SELECT task, evidence_id AS e FROM ref) ref USING (task, e) GROUP BY task)
SELECT task, (SELECT count(*) FROM reg WHERE reg.task = p.task) AS facts, (SELECT count(*) FROM ref WHERE ref.task = p.task) AS "references", dangling, orphan, 0::BIGINT AS ambiguous, dangling + orphan = 0 AS closed FROM p""".replace("\\\\.", "\\."))
def task_audit_views(spark, sf_dir):
    facts = registry.registered(_reports(spark, sf_dir), "task", "report")
    told = F.when((F.col("task") % 9 == 2) & F.col("path").endswith("price"), F.concat("evidence_id", F.lit("x"))).otherwise(F.col("evidence_id"))
    asked = facts.where(~((F.col("task") % 7 == 3) & F.col("path").endswith("status"))).select("task", told.alias("evidence_id"))
    return registry.task_views(facts, asked, "task")


# Orders are audits of pilots: written in some order of keys, with blanks; some hold a key twice, were changed, or are cut off.
@query("""WITH a AS (SELECT o_orderkey AS project, o_orderkey % 8 AS c, '{"cents":' || round(o_totalprice * 100)::BIGINT || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS t FROM orders)
SELECT project, CASE WHEN c = 1 THEN 'closed' ELSE 'open' END AS state, c <> 2 AS verified,
  CASE c WHEN 1 THEN 'not_open' WHEN 2 THEN 'gates' WHEN 3 THEN 'ambiguous_audit' WHEN 4 THEN 'changed_audit' WHEN 5 THEN 'malformed_audit' WHEN 6 THEN 'missing_audit' WHEN 7 THEN 'ambiguous_audit' ELSE 'closed' END AS outcome FROM a""")
def pilot_close(spark, sf_dir):
    c = F.col("o_orderkey") % 8
    cents, key, status = F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders")
    plain = F.concat(F.lit('{"cents":'), cents, F.lit(',"key":'), key, F.lit(',"status":"'), status, F.lit('"}'))
    twice = F.when(c == 3, F.concat(F.lit(', "key": '), key)).otherwise("")
    spread = F.concat(F.lit('{ "status": "'), status, F.lit('", "key": '), key, twice, F.lit(', "cents": '), F.when(c == 4, F.concat(F.lit("1"), cents)).otherwise(cents), F.when(c == 5, "").otherwise(" }"))
    audits = orders.where(c != 6).select(F.col("o_orderkey").alias("project"), spread.alias("audit"), F.sha2(plain, 256).alias("digest"), c.alias("c"))
    audits = audits.union(audits.where("c = 7")).drop("c")
    runs = orders.select(F.col("o_orderkey").alias("project"), F.when(c == 1, "closed").otherwise("open").alias("state"), (c != 2).alias("verified"))
    return pilots.closed(runs, audits)


_SHAPES = [
    ("thread/started", '"thread":{"id":"%s","createdAt":5}', None), ("thread/archived", '"threadId":"%s"', None), ("thread/unarchived", '"threadId":"%s","thread":{"id":"%s"}', None),
    ("turn/started", '"threadId":"%s","turn":{"id":"t"}', None), ("turn/completed", '"threadId":"%s","turnId":"t","turn":{"id":"t","status":"completed"}', None), ("item/started", '"threadId":"%s","turnId":"t","item":{"id":"i"}', None),
    ("item/completed", '"threadId":"%s","turnId":"t","item":{"id":"i"}', None), ("thread/tokenUsage/updated", '"threadId":"%s","tokenUsage":{}', None),
    ("turn/started", '"threadId":"%s","thread":{"id":"other"},"turnId":"t"', "incoherent_identity"), ("turn/completed", '"threadId":"%s","turnId":"t","turn":{"id":"u"}', "incoherent_identity"),
    ("thread/archived", '"threadId":7,"thread":{"id":"%s"}', "incoherent_identity"), ("thread/started", '"threadId":"%s","thread":{}', "incoherent_identity"), ("thread/started", '"thread":"%s"', "incoherent_identity"),
    ("thread/archived", '"other":"%s"', "missing_session"), ("item/started", '"threadId":"%s","item":{"id":"i"}', "missing_turn"), ("item/started", '"threadId":"%s","turnId":"t","item":{}', "missing_item"),
    ("thread/renamed", '"threadId":"%s"', "unknown_method"), ("thread/archived", '"threadId":"x","threadId":"%s"', "repeated_key"), ("thread/archived", '"threadId":%s', "malformed_json"),
]


@query(f"""WITH {OBS}, s AS (SELECT event_id, user_id, event_id % {len(_SHAPES)} AS c FROM obs) SELECT event_id, CASE {" ".join(f"WHEN c = {i} THEN '{x}'" for i, (*_, x) in enumerate(_SHAPES) if x)} END AS issue,
  CASE {" ".join(f"WHEN c = {i} THEN '{exports.METHODS[m]}'" for i, (m, _, x) in enumerate(_SHAPES) if not x)} END AS kind, CASE WHEN c < {sum(x is None for *_, x in _SHAPES)} THEN user_id END AS of_user FROM s""")
def message_identities(spark, sf_dir):
    """Every event is a message of one of the shapes above; a sound one names its user's session."""
    # few bytes a row and much work: dealt anew, since the files alone make few tasks
    obs = observations(spark, sf_dir).select("event_id", "user_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    line = F.lit(None).cast("string")
    for i, (method, params, _) in enumerate(_SHAPES):
        line = F.when(F.col("event_id") % len(_SHAPES) == i, F.replace(F.lit(f'{{"method":"{method}","params":{{{params}}}}}'), F.lit("%s"), user)).otherwise(line)
    key = b"\x07" * 32
    found = exports.app_server(obs.withColumn("line", line), key)
    from ..functions.keys import pseudonym

    mine = F.when(F.col("session_key") == pseudonym("session", F.concat(F.lit("u"), F.col("user_id").cast("string")), key), F.col("user_id"))
    return found.select("event_id", "issue", "kind", mine.alias("of_user"))
