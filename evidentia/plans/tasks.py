"""Queries over task plans: the parts are sessions, their lines the events of their turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks
from .adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# A part's parent is its half, the part after it (which makes cycles of two), or none that exists; some claims are ambiguous.
_SESSIONS = """s AS (SELECT p_partkey AS session_id, CASE WHEN p_partkey > 1 AND p_size % 3 <> 0 THEN CASE WHEN p_size = 7 THEN -p_partkey WHEN p_partkey % 40 = 11 THEN p_partkey + 1
    WHEN p_partkey % 40 = 12 THEN p_partkey - 1 ELSE p_partkey // 2 END END AS parent_id, CASE WHEN p_size = 8 THEN 'ambiguous' WHEN p_size % 2 = 0 THEN 'inferred' ELSE 'confirmed' END AS parent_kind,
    CASE WHEN p_size <> 10 THEN 757382400 + 5000000 * p_size END::BIGINT AS started FROM part),
l AS (SELECT l_partkey AS session_id, 't' || (l_linenumber % 3) AS turn, CASE l_returnflag WHEN 'A' THEN 'started' WHEN 'N' THEN 'completed' ELSE 'aborted' END AS kind, epoch(l_shipdate)::BIGINT AS moment,
    round(l_tax * 100)::BIGINT % 4 AS timing, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey::VARCHAR END AS source, l_orderkey AS ordinal FROM lineitem WHERE l_quantity <> 50)"""


def _sessions(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    twin = F.when(key % 40 == 11, key + 1).when(key % 40 == 12, key - 1).otherwise(F.floor(key / 2))
    parent = F.when((key > 1) & (size % 3 != 0), F.when(size == 7, -key).otherwise(twin))
    kind = F.when(size == 8, "ambiguous").when(size % 2 == 0, "inferred").otherwise("confirmed")
    return table(spark, sf_dir, "part").select(
        key.alias("session_id"), parent.alias("parent_id"), kind.alias("parent_kind"), F.when(size != 10, (757382400 + 5000000 * size.cast("long")) * 1_000_000_000).alias("started_ns"))


def _lifecycle(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "started").when(F.col("l_returnflag") == "N", "completed").otherwise("aborted")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("session_id"), F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")).alias("turn_id"), kind.alias("kind"),
        F.when(F.col("l_quantity") != 50, F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1_000_000_000).alias("observed_ns"), (F.round(F.col("l_tax") * 100).cast("long") % 4).alias("timing"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey").cast("string")).alias("source"), F.col("l_orderkey").alias("ordinal"))


_PLANS = f"""WITH RECURSIVE {_SESSIONS}, n AS (SELECT a.session_id AS node, b.session_id AS parent FROM s a LEFT JOIN s b ON a.parent_id = b.session_id AND a.parent_id <> a.session_id AND a.parent_kind <> 'ambiguous'
), reach AS (SELECT node, parent AS up FROM n WHERE parent IS NOT NULL UNION SELECT reach.node, n.parent FROM reach JOIN n ON n.node = up WHERE n.parent IS NOT NULL
), cycle AS (SELECT node FROM reach WHERE node = up
), rooted AS (SELECT n.node AS session_id, coalesce(min(up) FILTER (t.parent IS NULL AND up IS NOT NULL), min(up) FILTER (up IN (SELECT node FROM cycle)), n.node) AS root
  FROM n LEFT JOIN reach USING (node) LEFT JOIN n t ON t.node = up GROUP BY n.node
), own AS (SELECT l.*, started FROM l JOIN rooted r ON r.root = l.session_id AND r.session_id = l.session_id JOIN s ON s.session_id = l.session_id
), begun AS (SELECT session_id, least(min(started), min(moment) FILTER (kind = 'started')) AS begun FROM own GROUP BY session_id
), e AS (SELECT own.* FROM own JOIN begun USING (session_id) WHERE kind = 'started' OR moment >= begun
), turns AS (SELECT session_id, turn, max({{'g': timing, 'a': moment, 's': coalesce(source, ''), 'o': ordinal, 'k': kind, 'src': source}}) FILTER (kind <> 'started') AS t,
    max({{'g': timing, 'a': moment, 's': coalesce(source, ''), 'o': ordinal}}) FILTER (kind = 'started') AS b FROM e GROUP BY session_id, turn
), chosen AS (SELECT session_id, max({{'x': coalesce(b.a, t.a), 'a': t.a, 'g': t.g, 'turn': turn, 's': t.s, 'o': t.o, 'k': t.k, 'src': t.src}}) AS c FROM turns WHERE t IS NOT NULL GROUP BY session_id
), counted AS (SELECT session_id, any_value(c) AS c,
    bool_or(kind = 'started' AND (turn <> c.turn OR timing >= c.g) AND (moment > c.a OR moment = c.a AND CASE WHEN source IS NOT DISTINCT FROM c.src THEN ordinal > c.o ELSE turn <> c.turn END)) AS reopened,
    count(*) FILTER (kind <> 'started' AND turn = c.turn AND timing < c.g AND moment <> c.a) AS conflicts FROM e JOIN chosen USING (session_id) GROUP BY session_id
), seen AS (SELECT session_id, max(moment) AS moment FROM l WHERE kind = 'started' GROUP BY session_id
), last AS (SELECT root, max(greatest(started, seen.moment)) AS moment FROM rooted JOIN s USING (session_id) LEFT JOIN seen USING (session_id) GROUP BY root
), tasks AS (SELECT root, CASE WHEN ended AND c.k = 'completed' THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN ended THEN c.a ELSE last.moment END AS cutoff, CASE WHEN ended THEN c.src END AS cutoff_source,
    CASE WHEN ended THEN c.o END AS cutoff_ordinal, CASE WHEN ended THEN ['estimated', 'model_reported', 'derived', 'exact'][c.g + 1] ELSE 'derived' END AS timing,
    coalesce(conflicts, 0) AS timing_conflicts, coalesce(reopened, false) AS reopened
  FROM (SELECT last.root, last.moment AS moment, c, reopened, conflicts, coalesce(c IS NOT NULL AND NOT reopened, false) AS ended FROM last LEFT JOIN counted ON counted.session_id = root) last
), m AS (SELECT root, session_id, started, cutoff FROM rooted JOIN tasks USING (root) JOIN s USING (session_id) WHERE cutoff IS NOT NULL AND (started IS NULL OR started <= cutoff)
), alive AS (SELECT root FROM m WHERE root = session_id)"""


def _found(spark, sf_dir):
    lifecycle = _lifecycle(spark, sf_dir)
    return tasks.plans(_sessions(spark, sf_dir), lifecycle, lifecycle.where("kind = 'started' AND observed_ns IS NOT NULL").select("session_id", "observed_ns"))


@query(_PLANS + """ SELECT root, status, cutoff * 1000000000 AS cutoff_ns, cutoff_source, cutoff_ordinal, timing, timing_conflicts, reopened, members
FROM tasks JOIN alive USING (root) JOIN (SELECT root, count(*) AS members FROM m GROUP BY root) USING (root)""")
def task_plans(spark, sf_dir):
    return _found(spark, sf_dir).tasks


@query(_PLANS + " SELECT root, session_id, started * 1000000000 AS started_ns, cutoff * 1000000000 AS cutoff_ns FROM m JOIN alive USING (root)")
def task_members(spark, sf_dir):
    return _found(spark, sf_dir).members.select("root", "session_id", "started_ns", "cutoff_ns")
