"""Task plans, calls and intervals on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import calls, intervals, joins, lineage, tasks

SESSIONS = "session_id string, parent_id string, parent_kind string, started_ns long"
LIFECYCLE = "session_id string, turn_id string, kind string, observed_ns long, timing long, source string, ordinal long"


def plan(spark, sessions, lifecycle, activities=()):
    found = tasks.plans(
        spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame([(*e, None, None)[:7] if len(e) < 7 else e for e in lifecycle], LIFECYCLE),
        spark.createDataFrame(list(activities), "session_id string, observed_ns long"))
    told = {r["root"]: (r["status"], r["cutoff_ns"], r["timing"], r["reopened"]) for r in found.tasks.collect()}
    members = {}
    for r in found.members.collect():
        members.setdefault(r["root"], set()).add(r["session_id"])
    assert {r["root"]: r["members"] for r in found.tasks.collect()} == {k: len(v) for k, v in members.items()}
    return told, members


def test_orphans_cycles_open_and_reopened_roots(spark):
    sessions = [
        ("a", None, None, 10), ("a1", "a", "confirmed", 20), ("a2", "a1", "inferred", 95), ("late", "a", "confirmed", 150),
        ("orphan", "gone", "confirmed", 5), ("unsure", "a", "ambiguous", 7), ("x", "z", "confirmed", 30), ("y", "x", "confirmed", 31), ("z", "y", "confirmed", 32), ("tail", "x", "inferred", 33),
        ("again", None, None, 1), ("again1", "again", "confirmed", 2), ("nothing", None, None, None), ("self", "self", "confirmed", 3),
    ]
    lifecycle = [
        ("a", "t", "started", 11, 3), ("a", "t", "completed", 100, 3), ("orphan", "t", "started", 6, 3), ("again", "t1", "started", 1, 3), ("again", "t1", "completed", 50, 3), ("again", "t2", "started", 60, 3),
    ]
    told, members = plan(spark, sessions, lifecycle, [("again1", 90), ("orphan", 9), ("y", 77), ("a1", 400), ("nothing", None)])
    assert told["a"] == ("complete", 100, "exact", False) and members["a"] == {"a", "a1", "a2"}
    assert told["orphan"] == ("incomplete", 9, "derived", False) and told["unsure"] == ("incomplete", 7, "derived", False)
    assert told["x"] == ("incomplete", 77, "derived", False) and members["x"] == {"x", "y", "z", "tail"}
    assert told["again"] == ("incomplete", 90, "derived", True) and members["again"] == {"again", "again1"}
    assert told["self"] == ("incomplete", 3, "derived", False) and "nothing" not in told


def test_boundary_by_timing_and_turn(spark):
    sessions = [(s, None, None, 0) for s in ("weak", "abort", "early", "same", "tie")]
    lifecycle = [
        # within a turn the surer instant counts, though it is earlier; of two turns the one that began later
        ("weak", "t", "started", 1, 3), ("weak", "t", "completed", 90, 0), ("weak", "t", "completed", 70, 3),
        ("abort", "t1", "started", 5, 3), ("abort", "t1", "completed", 80, 3), ("abort", "t2", "started", 6, 3), ("abort", "t2", "aborted", 40, 3),
        # a later start of the same turn that is less sure doesn't reopen it
        ("same", "t", "started", 1, 3), ("same", "t", "completed", 50, 3), ("same", "t", "started", 60, 1),
        ("tie", "t", "completed", 50, 3, "f", 4), ("tie", "u", "started", 50, 3, "f", 3), ("tie", "u", "started", 50, 3, "f", 9),
    ]
    lifecycle += [("early", "t", "completed", -5, 3)]
    told, _ = plan(spark, sessions, lifecycle, [("early", 4)])
    assert told["weak"][:2] == ("complete", 70) and told["abort"][:2] == ("incomplete", 40) and told["same"][:2] == ("complete", 50)
    assert told["early"] == ("incomplete", 4, "derived", False)  # a terminal before anything began ends nothing
    assert told["tie"][3]


def test_no_sessions(spark):
    assert plan(spark, [], []) == ({}, {})


@pytest.mark.parametrize("seed, hot", [(0, False), (1, False), (2, True)])
def test_roots_against_following_parents(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(joins, "HOT_ROWS", 2)
        monkeypatch.setattr(joins, "HOT_SHARE", 0.05)
    r = random.Random(seed)
    parents = {i: (i + 1) % 150 if seed == 1 and i < 150 else None if r.random() < 0.05 else r.choice([r.randrange(200), max(i - 1, 0), 999]) for i in range(200)}

    def root(k):
        path = []
        while k not in path and parents.get(k) in parents and parents[k] != k:
            path.append(k)
            k = parents[k]
        return min(path[path.index(k) :]) if k in path else k

    found = lineage.roots(spark.createDataFrame(list(parents.items()), "node long, parent long"), "node", "parent").collect()
    assert {x["node"]: x["root"] for x in found} == {k: root(k) for k in parents}


def test_calls_in_generations(spark):
    rows = [
        ("c", 1, "result", None, "lost"), ("c", 2, "intent", "one", None), ("c", 3, "result", None, "r1"), ("c", 4, "result", None, "r2"), ("c", 5, "intent", "two", None), ("c", 6, "rejection", None, None),
        ("c", 7, "result", None, "ignored"), ("c", 8, "intent", "three", None), ("c", 9, "result", None, "r3"), ("d", 1, "result", None, "alone"), ("e", 1, "intent", "only", None),
    ]
    df = spark.createDataFrame(rows[::-1], "call string, at long, kind string, intent string, result string").repartition(3)
    found = {(r["call"], r["intent"]): (r["result"], r["results"], r["rejected"]) for r in calls.executions(df, ["call"], ["at"]).collect()}
    assert found == {("c", "one"): ("r2", 2, False), ("c", "two"): (None, 0, True), ("c", "three"): ("r3", 1, False), ("e", "only"): (None, 0, False)}


def test_spans_that_end_before_they_start(spark):
    rows = [("a", 1, "end", "x", 50, "success", None), ("a", 2, "start", "y", 70, None, None), ("b", 1, "start", "y", 5_000_000, None, None), ("b", 2, "end", "x", 9_000_000, "failed", None), ("c", 1, "end", "z", None, "success", 8)]
    df = spark.createDataFrame([(*r[:4], "tool", *r[4:], None) for r in rows], "call string, at long, kind string, tool string, category string, at_ns long, state string, latency_ms long, turn_id string")
    found = {r["call"]: (r["tool"], r["state"], r["latency_ms"], r["reversed"]) for r in calls.spans(df, ["call"], ["at"]).collect()}
    assert found == {"a": ("y", "success", None, True), "b": ("y", "failed", 4, False), "c": ("z", "success", 8, False)}


def test_positions_under_many_overlaps(spark):
    r = random.Random(5)
    made = [(r.choice(["k", "l"]), r.choice([None, r.randrange(100)]), r.randrange(3), r.choice([None, r.randrange(120)]), r.randrange(3), f"i{i}") for i in range(80)] + [(None, 1, 1, None, None, "nobody")]
    events = [(i, r.choice(["k", "l", "m"]), r.choice([None, r.randrange(110)]), r.randrange(3)) for i in range(200)]

    def first(key, at, seq):
        own = [(s, q, -(e if e is not None else 10**6), label) for k, s, q, e, f, label in made if k == key and s is not None and (e is None or (e, f) > (s, q)) and at is not None and (s, q) <= (at, seq) and (e is None or (at, seq) < (e, f))]
        return {x[3] for x in own if x[:2] == min(own)[:2]} if own else {None}

    df = spark.createDataFrame(made, "key string, start long, start_seq int, end long, end_seq int, label string")
    found = intervals.attribute_by_position(spark.createDataFrame(events, "id long, key string, at long, seq int"), df, ["key"], "at", "seq", "id")
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan_text
    rows = found.collect()
    assert len(rows) == len(events) and all(x["label"] in first(x["key"], x["at"], x["seq"]) for x in rows)
    counts = {x["key"]: (x["no_start"], x["not_after"]) for x in intervals.dropped(df.where(F.col("key").isNotNull()), ["key"]).collect()}
    assert counts == {k: (sum(m[1] is None for m in made if m[0] == k), sum(m[1] is not None and m[3] is not None and m[3:5] <= m[1:3] for m in made if m[0] == k)) for k in "kl"}
