"""Queries over sessions and their counters, intervals and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, intervals, runs
from .adapters import OBS, observations

QUERIES, ORACLES = {}, {}
HOUR = 3_600_000_000
OPENERS = ["signup", "purchase"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_EPOCHS = f"""WITH {OBS}, e AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS epoch FROM (
  SELECT *, CASE WHEN amount < lag(amount) OVER (PARTITION BY user_id ORDER BY at_us, event_id) THEN 1 ELSE 0 END AS fell FROM obs))"""


def _epochs(spark: SparkSession, sf_dir: str, components=("amount",)) -> DataFrame:
    return counters.with_epochs(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], list(components))


@query(_EPOCHS + " SELECT user_id, event_id, amount, epoch::BIGINT AS epoch FROM e")
def epoch_assignment(spark, sf_dir):
    return _epochs(spark, sf_dir).select("user_id", "event_id", "amount", "epoch")


@query(_EPOCHS + """ SELECT user_id, sum(amount)::BIGINT AS amount, count(*) AS epochs FROM (
  SELECT user_id, epoch, max_by(amount, (at_us, event_id)) AS amount FROM e GROUP BY ALL) GROUP BY user_id""")
def epoch_final_totals(spark, sf_dir):
    return counters.final_totals(_epochs(spark, sf_dir), ["user_id"], ["at_us", "event_id"], ["amount"])


@query(f"""WITH {OBS}, e AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS epoch FROM (
  SELECT *, CASE WHEN amount < lag(amount) OVER w OR k < lag(k) OVER w THEN 1 ELSE 0 END AS fell FROM obs
  WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)))
SELECT user_id, epoch::BIGINT AS epoch, max(amount) AS amount, max(k) AS k FROM e GROUP BY ALL""")
def epoch_component_max(spark, sf_dir):
    return counters.component_maxima(_epochs(spark, sf_dir, ("amount", "k")), ["user_id"], ["amount", "k"])


@query(f"""WITH RECURSIVE {OBS}, n AS (
  SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE amount + 9007199254740993 END AS amount, CASE WHEN event_id % 4 = 0 THEN NULL ELSE k END AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS r FROM obs
), f AS (
  SELECT user_id, event_id, r, 0::BIGINT AS epoch, amount AS ka, k AS kk FROM n WHERE r = 1
  UNION ALL
  SELECT n.user_id, n.event_id, n.r, f.epoch + fell, CASE WHEN fell = 1 THEN n.amount ELSE coalesce(n.amount, ka) END,
         CASE WHEN fell = 1 THEN n.k ELSE coalesce(n.k, kk) END
  FROM (SELECT n.*, f.epoch, f.ka, f.kk, CASE WHEN coalesce(n.amount < f.ka, false) OR coalesce(n.k < f.kk, false) THEN 1 ELSE 0 END AS fell
        FROM f JOIN n ON n.user_id = f.user_id AND n.r = f.r + 1) AS n, (SELECT 1) AS one(x), LATERAL (SELECT n.epoch AS epoch) AS f
) SELECT user_id, event_id, epoch FROM f""")
def epoch_assignment_gaps(spark, sf_dir):
    gaps = observations(spark, sf_dir).withColumns({
        "amount": F.when(F.col("event_id") % 3 != 0, F.col("amount") + 9007199254740993), "k": F.when(F.col("event_id") % 4 != 0, F.col("k"))})
    rows = gaps.select("user_id", "event_id", "at_us", "amount", "k")
    return counters.with_epochs_over_gaps(rows, ["user_id"], ["at_us", "event_id"], ["amount", "k"]).select("user_id", "event_id", "epoch")


@query(_EPOCHS + """ SELECT user_id, event_id, epoch::BIGINT AS epoch, ordinal, delta FROM (
  SELECT *, row_number() OVER w AS ordinal, amount - coalesce(lag(amount) OVER w, 0) AS delta FROM e
  WINDOW w AS (PARTITION BY user_id, epoch ORDER BY at_us, event_id)) WHERE delta <> 0""")
def counter_deltas(spark, sf_dir):
    found = counters.deltas(_epochs(spark, sf_dir), ["user_id"], ["at_us", "event_id"], "amount")
    return found.select("user_id", "event_id", "epoch", "ordinal", "delta")


@query(f"""WITH {OBS} SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS b FROM obs) WHERE b IS NULL OR b <> event_type""")
def vector_derun(spark, sf_dir):
    return counters.without_repeats(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query(f"""WITH {OBS} SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM obs""")
def forward_fill(spark, sf_dir):
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return counters.last_known(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], signup, "signup_id").select("user_id", "event_id", "signup_id")


_ATTRIBUTED = f"""WITH {OBS}, i AS (
  SELECT user_id, at_us AS s, lead(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS e, event_type AS label
  FROM obs WHERE event_type IN ('signup', 'purchase')
), a AS (
  SELECT o.event_id, any_value(o.user_id) AS user_id, any_value(o.event_type) AS event_type, any_value(o.amount) AS amount,
         max_by(label, (s, label)) AS label, count(label) > 1 AS overlap
  FROM (SELECT * FROM obs WHERE event_type NOT IN ('signup', 'purchase')) o
  LEFT JOIN i ON i.user_id = o.user_id AND o.at_us >= s AND (e IS NULL OR o.at_us < e) GROUP BY o.event_id
)"""


def _attributed(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    marks, events = obs.where(F.col("event_type").isin(OPENERS)), obs.where(~F.col("event_type").isin(OPENERS))
    made = intervals.from_marks(marks, ["user_id"], "at_us", "event_id", "event_type")
    return intervals.attribute(events, made, ["user_id"], "at_us", "event_id", 24 * HOUR)


@query(_ATTRIBUTED + " SELECT event_id, user_id, label, overlap FROM a")
def interval_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).select("event_id", "user_id", "label", "overlap")


@query(_ATTRIBUTED + " SELECT label, event_type, count(*) AS n FROM a GROUP BY ALL")
def interval_crosstab(spark, sf_dir):
    return intervals.crosstab(_attributed(spark, sf_dir), ["label", "event_type"])


@query(_ATTRIBUTED + """ SELECT user_id, sum(amount)::BIGINT AS total, coalesce(sum(amount) FILTER (label = 'signup'), 0)::BIGINT AS in_signup,
  coalesce(sum(amount) FILTER (label = 'purchase'), 0)::BIGINT AS in_purchase, coalesce(sum(amount) FILTER (label = 'finish'), 0)::BIGINT AS in_finish,
  (sum(amount) - coalesce(sum(amount) FILTER (label IN ('signup', 'purchase', 'finish')), 0))::BIGINT AS unclassified FROM a GROUP BY user_id""")
def phase_coverage(spark, sf_dir):
    return intervals.coverage(_attributed(spark, sf_dir), ["user_id"], "amount", [*OPENERS, "finish"])


@query(f"""WITH {OBS}, m AS (SELECT user_id, at_us AS s, event_id AS ss, event_type AS label, lead(at_us) OVER w AS e, lead(event_id) OVER w AS es
  FROM obs WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT o.event_id, min_by(label, (s, ss)) AS label FROM (SELECT * FROM obs WHERE event_type = 'view') o
LEFT JOIN m ON m.user_id = o.user_id AND (o.at_us, o.event_id) >= (s, ss) AND (e IS NULL OR (o.at_us, o.event_id) < (e, es)) GROUP BY o.event_id""")
def position_attribution(spark, sf_dir):
    from pyspark.sql import Window

    obs = observations(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    marks = obs.where(F.col("event_type").isin(OPENERS)).select(
        "user_id", F.col("at_us").alias("start"), F.col("event_id").alias("start_seq"), F.lead("at_us").over(w).alias("end"),
        F.lead("event_id").over(w).alias("end_seq"), F.col("event_type").alias("label"))
    views = obs.where("event_type = 'view'").select("user_id", "event_id", "at_us")
    return intervals.attribute_by_position(views, marks, ["user_id"], "at_us", "event_id", "event_id").select("event_id", "label")


# Intervals of any length from every purchase and signup: many overlap, some never end, some have no start or end before it.
_SPREAD = f"""{OBS}, iv AS (SELECT user_id, CASE WHEN k % 11 <> 0 THEN at_us END AS s, event_id AS ss, CASE WHEN k % 13 <> 0 THEN at_us + (amount % 90 - 5) * {HOUR} END AS e, event_id % 7 AS es, event_type || k AS label
  FROM obs WHERE event_type IN ('signup', 'purchase'))"""


def _spread(spark, sf_dir) -> DataFrame:
    k, at = F.col("k"), F.col("at_us")
    return observations(spark, sf_dir).where(F.col("event_type").isin(OPENERS)).select(
        "user_id", F.when(k % 11 != 0, at).alias("start"), F.col("event_id").alias("start_seq"), F.when(k % 13 != 0, at + (F.col("amount") % 90 - 5) * HOUR).alias("end"), (F.col("event_id") % 7).alias("end_seq"),
        F.concat("event_type", k.cast("string")).alias("label"))


@query(f"""WITH {_SPREAD} SELECT o.event_id, min_by(label, (s, ss)) AS label FROM (SELECT * FROM obs WHERE event_type NOT IN ('signup', 'purchase')) o
LEFT JOIN iv ON iv.user_id = o.user_id AND s IS NOT NULL AND (o.at_us, o.event_id) >= (s, ss) AND (e IS NULL OR (o.at_us, o.event_id) < (e, es)) GROUP BY o.event_id""")
def position_overlaps(spark, sf_dir):
    events = observations(spark, sf_dir).where(~F.col("event_type").isin(OPENERS)).select("user_id", "event_id", "at_us")
    return intervals.attribute_by_position(events, _spread(spark, sf_dir), ["user_id"], "at_us", "event_id", "event_id").select("event_id", "label")


@query(f"""WITH {_SPREAD} SELECT user_id, count_if(s IS NULL) AS no_start, count_if(s IS NOT NULL AND e IS NOT NULL AND (e, es) <= (s, ss)) AS not_after FROM iv GROUP BY user_id
HAVING count_if(s IS NULL) > 0 OR count_if(s IS NOT NULL AND e IS NOT NULL AND (e, es) <= (s, ss)) > 0""")
def dropped_intervals(spark, sf_dir):
    return intervals.dropped(_spread(spark, sf_dir), ["user_id"])


@query(f"""WITH {OBS} SELECT e.event_id, e.user_id, c.event_id AS click_id FROM (SELECT * FROM obs WHERE event_type = 'error') e
  ASOF LEFT JOIN (SELECT * FROM obs WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.at_us >= c.at_us""")
def asof_backward(spark, sf_dir):
    obs = observations(spark, sf_dir).select("event_id", "user_id", "at_us", "event_type")
    clicks = obs.where("event_type = 'click'").withColumn("click", F.col("event_id"))
    found = intervals.as_of(obs.where("event_type = 'error'"), clicks, ["user_id"], "at_us", "click", "click_id", "event_id")
    return found.select("event_id", "user_id", "click_id")


@query(f"""WITH {OBS}, s AS (SELECT user_id, min(at_us) AS start FROM obs GROUP BY user_id),
b AS (SELECT s.user_id, max_by(amount, (at_us, event_id)) AS baseline FROM s JOIN obs ON obs.user_id = s.user_id AND at_us BETWEEN start AND start + {HOUR} GROUP BY ALL),
t AS (SELECT user_id, max(amount) AS total FROM obs GROUP BY user_id)
SELECT user_id, baseline, total, greatest(0, total - baseline) AS own FROM t LEFT JOIN b USING (user_id)""")
def replay_window(spark, sf_dir):
    obs = observations(spark, sf_dir)
    starts = obs.groupBy("user_id").agg(F.min("at_us").alias("start"))
    found = intervals.baseline_in_window(starts, obs, ["user_id"], "start", "at_us", HOUR, "amount", "event_id")
    totals = obs.groupBy("user_id").agg(F.max("amount").alias("total"))
    return totals.join(found, "user_id", "left").select("user_id", "baseline", "total", intervals.contribution(F.col("total"), F.col("baseline")).alias("own"))


@query(f"""WITH {OBS}, p AS (
  SELECT user_id, at_us, event_id, event_type, lead(event_type) OVER w AS t, lead(at_us) OVER w AS e FROM obs WHERE event_type IN ('signup', 'purchase')
  WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT user_id, event_id AS start_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS attempt,
  CASE WHEN t = 'purchase' THEN 'completed' ELSE 'open' END AS state, CASE WHEN t = 'purchase' THEN (e - at_us) // 1000 END AS duration_ms
FROM p WHERE event_type = 'signup'""")
def lifecycle_pairing(spark, sf_dir):
    found = runs.paired(observations(spark, sf_dir), ["user_id"], "at_us", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return found.select("user_id", F.col("event_id").alias("start_id"), "attempt", "state", "duration_ms")


@query(f"""WITH {OBS}, r AS (
  SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS clicks FROM obs
), t AS (
  SELECT user_id, event_id, event_type, row_number() OVER w AS attempt, lag(event_type) OVER w AS before, clicks - lag(clicks) OVER w AS edits
  FROM r WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)
) SELECT user_id, event_id, attempt, CASE WHEN before IS NULL OR before <> 'error' THEN 'none' WHEN event_type = 'error' THEN 'none'
    WHEN edits > 0 THEN 'fix_verified' ELSE 'flaky_retry' END AS retry FROM t""")
def retry_classification(spark, sf_dir):
    obs = observations(spark, sf_dir)
    found = runs.retries(obs, ["user_id"], "at_us", "event_id", is_run=F.col("event_type").isin("error", "purchase"), failed=F.col("event_type") == "error", edited=F.col("event_type") == "click")
    return found.select("user_id", "event_id", "attempt", "retry")


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM obs)
SELECT user_id, event_id, event_type, greatest(0, n - 20) AS truncated FROM r WHERE r <= 20""")
def timeline_last_n(spark, sf_dir):
    return runs.latest(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], 20).select("user_id", "event_id", "event_type", "truncated")


@query(f"""WITH {OBS}, g AS (SELECT event_type, at_us - lag(at_us) OVER (PARTITION BY event_type ORDER BY at_us, event_id) AS gap FROM obs)
SELECT event_type, count(gap) AS n, quantile_disc(gap // 1000, 0.95)::BIGINT AS p95_ms FROM g WHERE gap IS NOT NULL GROUP BY event_type""")
def p95_nearest_rank(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("at_us", "event_id")
    gaps = observations(spark, sf_dir).withColumn("gap_ms", F.floor((F.col("at_us") - F.lag("at_us").over(w)) / 1000)).where("gap_ms IS NOT NULL")
    return runs.nearest_rank(gaps, ["event_type"], "gap_ms", 0.95, "p95_ms")
