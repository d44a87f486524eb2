"""Origins, audits, shapes and bounded histories on small fixtures."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import shapes
from evidentia.operators import audit, counters, facts, origins, pilots


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_prefix_lineage_takes_the_longest_clean_one(spark):
    known = [("s", "a", i, x) for i, x in enumerate("xyz")] + [("s", "b", i, x) for i, x in enumerate("xy")] + [("s", "c", i, x) for i, x in enumerate("xq")] + [("t", "d", 0, "x")]
    current = [("s", "new", i, x) for i, x in enumerate("xyzw")] + [("s", "cut", 0, "x"), ("s", "other", 0, "k")]
    k = spark.createDataFrame(known, "grp string, logical string, line long, x string")
    c = spark.createDataFrame(current, "grp string, source string, line long, x string")
    assert rows(origins.prefix_lineage(k, c, ["grp"], "line", "x"), "source", "logical", "shared") == [("cut", "c", 1), ("new", "a", 3)]
    assert rows(origins.prefix_lineage(k.limit(0), c, ["grp"], "line", "x"), "source") == []


def test_worktrees_need_one_trusted_place(spark):
    threads = spark.createDataFrame([("ok", "t1"), ("ok", "t2"), ("two", "t1"), ("two", "t3"), ("lost", "t1"), ("lost", "t9"), ("none", None), ("roots", "t3"), ("bare", "t4")], "source string, thread string")
    sessions = spark.createDataFrame([("t1", "p", "w"), ("t2", "p", "w"), ("t3", "p", "v"), ("t4", "q", "w")], "thread string, project string, worktree string")
    roots = spark.createDataFrame([("p", "w", "/a"), ("p", "v", "/b"), ("p", "v", "/c")], "project string, worktree string, root string")
    found = {r["source"]: (r["worktree"], r["diagnostic"]) for r in origins.worktrees(threads, sessions, sessions.select("thread", "project"), roots).collect()}
    assert found == {"ok": ("w", None), "two": (None, "ambiguous"), "lost": (None, "unavailable"), "none": (None, "unavailable"), "roots": (None, "ambiguous"), "bare": (None, "unavailable")}


def test_shapes(spark):
    given = ['{"b": 1, "a": "x", "c": 1.0, "d": null, "e": [1], "f": {"g": 2}, "h": true, "i": 123456789012345678901}', "[]", "null", "1.0", None, "{", "{}"]
    df = spark.createDataFrame([(g,) for g in given], "j string").select(shapes.shape("j").alias("s"))
    assert [r["s"] for r in df.collect()] == ["a:str,b:int,c:float,d:NoneType,e:list,f:dict,h:bool,i:int", "list", "NoneType", "float", None, None, ""]


def test_private_fields_are_found_at_any_depth(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("ok"), F.array(F.struct(F.lit(1).alias("prompt"))).alias("xs")).alias("a"), F.struct(F.lit(1).alias("prompt")).alias("kind_counts"))
    assert audit.private_fields(df.schema) == ["a.xs.prompt"]
    with pytest.raises(ValueError, match="a.xs.prompt"):
        audit.public(df)
    assert audit.public(df.select("kind_counts")).count() == 1


def test_epoch_vectors_with_missing_instants(spark):
    df = spark.createDataFrame([("s", 0, 10, 1, 5, None), ("s", 0, 20, 2, 7, 3), ("s", 1, 30, 3, 9, 1), ("s", 1, None, 0, 4, None)], "s string, epoch int, at long, line int, a long, b long")
    assert rows(counters.epoch_vectors(df, ["s"], "at", ["line"], ["a", "b"]), "epoch", "a", "b", "least_a", "least_b", "ambiguous") == [(0, 7, 3, 7, 3, False), (1, 4, 1, 9, 1, True)]


def test_earlier_ignores_equal_instants_and_keeps_four(spark):
    df = spark.createDataFrame([("f", 1, i, i) for i in range(6)] + [("f", 2, 9, 9), ("f", 3, 10, 10)], "f string, at long, ref long, v long")
    found = {r["ref"]: [x["v"] for x in r["_last"]] for r in facts.earlier(df, ["f"], "at", "ref", ["v"], 4).collect()}
    assert found[0] == found[5] == [] and found[9] == [2, 3, 4, 5] and found[10] == [3, 4, 5, 9]
    assert rows(facts.trend(df, ["f"], "at", "v"), "ref", "twice_median", "warning")[-2:] == [(9, 7, True), (10, 9, True)]


def test_assessment_needs_a_signal(spark):
    df = spark.createDataFrame([("f", i, i, 10, 1) for i in range(4)] + [("f", 5, 5, 20, 1), ("f", 6, 6, 20, 9), ("f", 7, 7, None, 9)], "f string, at long, ref long, w long, x long")
    found = {r["ref"]: (r["warning"], r["signal"], r["caveat"]) for r in audit.assess(df, ["f"], "at", "ref", "w", ["x"]).collect()}
    assert found[3] == (False, None, "too_few_tasks") and found[5] == (False, None, "no_corroborating_signal")
    assert found[6] == (True, "x", None) and found[7] == (False, None, "amount_unavailable")


def test_stale_stats_and_disagreements(spark):
    reports = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, at long")
    kept = spark.createDataFrame([("a", 2, 1, 2), ("c", 1, 1, 1)], "k string, n long, first_at long, last_at long")
    assert rows(audit.stale_stats(kept, reports, "k", "at"), "k", "problem") == [("b", "missing"), ("c", "orphan")]
    left = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, s string, n long")
    right = spark.createDataFrame([("a", None, 2), ("b", "y", None)], "k string, s string, n long")
    assert rows(audit.disagreements(left, right, "k", ["s"], ["n"]), "k", "field") == [("a", "n"), ("b", "s")]


def test_pilots_open_once_and_need_every_gate(spark):
    runs = spark.createDataFrame([("a", 5, "docs", "open"), ("b", 5, "docs", "closed")], "project string, target int, family string, state string")
    asked = spark.createDataFrame([(1, "a", 5, "docs"), (2, "a", 6, "docs"), (3, "b", 7, "test"), (4, "b", 7, "test"), (5, "b", 5, "docs"), (6, "c", 0, "docs"), (7, None, 5, "docs")], "at long, project string, target int, family string")
    assert [x[1] for x in rows(pilots.started(runs, asked, "at"), "at", "outcome")] == ["resumed", "refused", "started", "resumed", "refused", "invalid", "invalid"]
    fields = "id int, target int, completed long, enrolled long, failures long, finish_missing long, conflicts long, issues long, coverage double, least_coverage double, p95_ms long"
    cohorts = spark.createDataFrame([(1, 3, 5, 5, 0, 0, 0, 0, 0.85, 0.6, 2000), (2, 3, 4, 4, 0, 0, 0, 0, 0.9, 0.9, 10), (3, 3, 5, 5, 0, 0, 0, 0, 0.9, 0.9, None)], fields)
    assert rows(pilots.decided(cohorts), "id", "enough_tasks", "fast", "passed") == [(1, True, True, True), (2, False, True, False), (3, True, False, False)]
