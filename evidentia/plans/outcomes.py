"""Queries over outcomes of calls, states, an observer's own calls, headers of files, and hints for tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import commands, text
from ..operators import tree
from ..sources import rollout
from .adapters import OBS, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_L = ", ".join(_LINE)
_C = "(l_partkey + l_linenumber) % 9"


@query(f"""WITH x AS (SELECT {_L}, {_C} AS c, l_quantity::BIGINT % 3 AS e, l_suppkey % 4 AS d FROM lineitem),
r AS (SELECT *, c IN (0, 1, 2, 3) AS known, CASE c WHEN 4 THEN 'conflicted' ELSE 'result_without_exit' END AS missing FROM x)
SELECT {_L}, CASE WHEN known THEN e END AS exit_status, CASE WHEN NOT known THEN 'unknown' WHEN e = 0 THEN 'success' ELSE 'failed' END AS outcome,
  CASE WHEN NOT known THEN 'unknown' WHEN e = 0 THEN 'none' WHEN d IN (1, 2) AND c <> 3 THEN 'infra_failure' ELSE 'product_failure' END AS cause, CASE WHEN known THEN 'complete' ELSE missing END AS completeness FROM r""")
def structured_results(spark, sf_dir):
    """Outputs in every form: an object, a list with one, with text that holds one, with two, and what holds no exit status."""
    code = (F.col("l_quantity").cast("long") % 3).cast("string")
    said = F.element_at(F.array(*map(F.lit, ("fine", "Connection REFUSED", "x sandbox y", "assertion"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    one = F.concat(F.lit('{"stderr":"'), said, F.lit('","exit_code":'), code, F.lit("}"))
    escaped = F.replace(one, F.lit('"'), F.lit('\\"'))
    forms: list[Column] = [
        one, F.concat(F.lit('["words",'), one, F.lit("]")), F.concat(F.lit('[{"type":"input_text","text":"'), escaped, F.lit('"}]')), F.concat(F.lit('[{"exit_code":'), code, F.lit("},{}]")),
        F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")), F.lit('{"exit_code":"0"}'), F.lit('{"exit_code":true}'), F.lit("exit code 0"), F.lit("[]")]
    lines = table(spark, sf_dir, "lineitem")
    at, output = (F.col("l_partkey") + F.col("l_linenumber")) % 9, F.lit(None).cast("string")
    for i, form in enumerate(forms):  # a row makes its own form only
        output = F.when(at == i, form).otherwise(output)
    found = lines.select(*_LINE, F.struct(*[v.alias(k) for k, v in text.structured_result(output).items()]).alias("r"))
    return found.select(*_LINE, "r.*")


@query(f"""WITH x AS (SELECT {_L}, {_C} AS c, l_quantity::BIGINT AS q FROM lineitem)
SELECT {_L}, CASE WHEN c IN (0, 1) THEN 'success' WHEN c IN (2, 3, 4) THEN 'failed' ELSE 'unknown' END AS outcome,
  CASE c WHEN 0 THEN q * 1000 WHEN 1 THEN q WHEN 2 THEN q * 1000 + 500 WHEN 5 THEN q * 1000 END AS latency_ms FROM x""")
def wrapper_outcomes(spark, sf_dir):
    q = F.col("l_quantity").cast("long").cast("string")
    forms: list[Column] = [
        F.concat(F.lit("Script completed\nWall time: "), q, F.lit(" seconds")), F.concat(F.lit("script COMPLETED, elapsed="), q, F.lit("ms")), F.concat(F.lit("it failed; wall time "), q, F.lit(".5 s")),
        F.lit("an Error"), F.concat(F.lit("exit code "), F.lit("7")), F.concat(F.lit("Elapsed "), q, F.lit(" seconds")), F.lit("exit code 0"), F.lit(""), F.lit("nothing")]
    made = table(spark, sf_dir, "lineitem").select(*_LINE, F.element_at(F.array(*forms), ((F.col("l_partkey") + F.col("l_linenumber")) % 9 + 1).cast("int")).alias("t"))
    return made.select(*_LINE, *[v.alias(k) for k, v in text.wrapper_outcome(F.col("t")).items()])


_KINDS = ("turn_started", "conversation_started", "user_prompt", "turn_completed", "item_completed")
_STATES = ("inProgress", "completed", "failed", "interrupted", "cancelled", "declined", "success", "odd")


@query(f"""WITH {OBS}, x AS (SELECT event_id, {list(_KINDS)}[event_id % 5 + 1] AS kind, {list(_STATES)}[k % 8 + 1] AS told FROM obs)
SELECT event_id, CASE told WHEN 'inProgress' THEN 'in_progress' WHEN 'odd' THEN 'unknown' ELSE told END AS state,
  CASE WHEN kind IN ('turn_started', 'conversation_started', 'user_prompt') THEN 'started' WHEN kind = 'turn_completed' THEN CASE WHEN told IN ('interrupted', 'cancelled') THEN 'aborted' ELSE 'completed' END END AS does FROM x""")
def states_of_turns(spark, sf_dir):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    rows = observations(spark, sf_dir).select("event_id", pick(_KINDS, F.col("event_id") % 5).alias("kind"), text.status(pick(_STATES, F.col("k") % 8)).alias("state"))
    return rows.select("event_id", "state", text.lifecycle(F.col("kind"), F.col("state")).alias("does"))


@query(f"""SELECT {_L}, {_C} IN (0, 1, 2, 3) AS own FROM lineitem""")
def own_calls(spark, sf_dir):
    """Commands that call a program, in several ways, with the order they are about."""
    forms = ["watcher report {}", "env A=1 B=2 /usr/bin/watcher audit {}", "python3 -m watch.er report --of {}", "A=b watcher report '{}'", "watcher other {}", "echo watcher report {}", "watcher report {} | cat", "mywatcher report {}", "python -m other report {}"]
    made = [F.replace(F.lit(f), F.lit("{}"), F.col("l_orderkey").cast("string")) for f in forms]
    rows = table(spark, sf_dir, "lineitem").select(*_LINE, F.element_at(F.array(*made), ((F.col("l_partkey") + F.col("l_linenumber")) % 9 + 1).cast("int")).alias("command"))
    return rows.select(*_LINE, commands.calls(F.col("command"), "watcher", "watch.er", ["report", "audit"]).alias("own"))


@query(f"""WITH {OBS}, m AS (SELECT user_id, event_id, CASE WHEN k % 3 = 0 THEN 'u' || user_id WHEN k % 3 = 1 THEN user_id::VARCHAR ELSE 'x' || k END AS id FROM obs WHERE event_type = 'view')
SELECT user_id, coalesce(max_by(id, (length(id), -event_id)) FILTER (id = 'u' || user_id OR id = 'a-u' || user_id), min_by(id, event_id)) AS session_id FROM m GROUP BY user_id""")
def header_selection(spark, sf_dir):
    """A user is a file whose name ends in one of the ids that its headers tell; where none does the first header counts."""
    k, user = F.col("k"), F.col("user_id").cast("string")
    own = F.when(k % 3 == 0, F.concat(F.lit("u"), user)).when(k % 3 == 1, user).otherwise(F.concat(F.lit("x"), k.cast("string")))
    rows = observations(spark, sf_dir).where("event_type = 'view'").select(
        "user_id", F.concat(F.lit("/f/a-u"), user, F.lit(".jsonl")).alias("path"), F.col("event_id").alias("ordinal"), F.lit("session_meta").alias("route"), F.to_json(F.struct(own.alias("id"))).alias("payload"))
    found = rollout.session_headers(rows)
    return rows.select("user_id", "path").distinct().join(found, "path").select("user_id", "session_id")


_HINTS = """d AS (SELECT l_suppkey AS s, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS e, l_quantity::BIGINT AS v, l_returnflag AS f FROM lineitem WHERE l_returnflag <> 'R'),
h AS (SELECT l_suppkey AS s, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS e, CASE WHEN l_suppkey % 7 = 3 THEN l_quantity::BIGINT * 9 ELSE l_quantity::BIGINT // 2 END AS v FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT s, d.v AS dv, h.v AS hv FROM (SELECT s, sum(v) AS v FROM d GROUP BY s) d JOIN (SELECT s, sum(v) AS v FROM h GROUP BY s) h USING (s) WHERE h.v <= d.v)"""


@query(f"""WITH {_HINTS} SELECT s AS session_id, e AS event_key, v::BIGINT AS input, 'delta' AS origin FROM d WHERE s NOT IN (SELECT s FROM t)
UNION ALL SELECT s, e, v, 'hint' FROM h WHERE s IN (SELECT s FROM t) UNION ALL SELECT s, 'residual:' || s, (dv - hv)::BIGINT, 'residual' FROM t WHERE dv <> hv""")
def hint_allocation(spark, sf_dir):
    """A supplier's returned lines are hints for what its other lines used."""
    lines = table(spark, sf_dir, "lineitem")
    q, key = F.col("l_quantity").cast("long"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("event_key")
    zero = [F.lit(0).cast("long").alias(c) for c in ("cached", "output", "reasoning")]
    own = [F.col("l_suppkey").alias("session_id"), key, F.lit(1).cast("long").alias("observed_ns")]
    deltas = lines.where("l_returnflag <> 'R'").select(*own, q.alias("input"), *zero)
    hints = lines.where("l_returnflag = 'R'").select(*own, F.when(F.col("l_suppkey") % 7 == 3, q * 9).otherwise(F.floor(q / 2)).alias("input"), *zero)
    return tree.allocate_hints(deltas, hints).select("session_id", "event_key", "input", "origin")
