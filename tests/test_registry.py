"""Canonical texts, facts of reports, closures, and trees derived from a stream."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentia.functions import canonical
from evidentia.operators import pilots, registry
from evidentia.streaming import trees


def test_canonical_text(spark):
    row = Row(
        b=Row(z=1, a='qu"o\\te\né🙂', n=None), a=[1.0, 0.5, -0.0, 1e300, float("nan"), None], m={"y": decimal.Decimal("1.500"), "x": decimal.Decimal("2.000")}, t=datetime.datetime(2024, 1, 2, 3, 4, 5, 6), e=[], y=True, bin=bytearray(b"\x00\xff"))
    df = spark.createDataFrame([row], "b struct<z:int,a:string,n:string>, a array<double>, m map<string,decimal(10,3)>, t timestamp, e array<int>, y boolean, bin binary")
    text = df.select(canonical.canonical(F.struct(*df.columns), df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType).alias("t")).first()["t"]
    assert text == '{"a":[1,0.5,0,1.0E300,"NaN",null],"b":{"a":' + json.dumps('qu"o\\te\né🙂', ensure_ascii=False) + ',"n":null,"z":1},"bin":"AP8=","e":[],"m":{"x":2,"y":1.5},"t":"2024-01-02T03:04:05.000006Z","y":true}'
    assert list(json.loads(text)) == sorted(json.loads(text))


def test_repeated_keys_and_text(spark):
    given = [('{"a":1,"b":{"c":[{"d":1,"d":2}]}}', True, None), ('{"b": 1, "a": [1, {"y":2,"x":null}]}', False, '{"a":[1,{"x":null,"y":2}],"b":1}'), ("{broken", None, None), (None, None, None), ("[]", False, "[]"), ('{"a":1,"a":1}', True, None)]
    df = spark.createDataFrame([(t,) for t, *_ in given], "t string")
    found = df.select("t", canonical.repeated_keys(F.col("t")).alias("r"), canonical.canonical_text(F.col("t")).alias("c")).collect()
    assert {(r["t"], r["r"], r["c"]) for r in found} == set(given)


def test_registry_and_closure(spark):
    rows = [("a", Row(x=1, deep=Row(k={"p/q": [1, 2], "~": []}, none=None))), ("b", None)]
    df = spark.createDataFrame(rows, "task string, report struct<x:int,deep:struct<k:map<string,array<int>>,none:string>>")
    found = registry.registered(df, "task", "report")
    assert {(r["task"], r["path"], r["value"]) for r in found.collect()} == {
        ("a", "/x", "1"), ("a", "/deep/k/p~1q/0", "1"), ("a", "/deep/k/p~1q/1", "2"), ("a", "/deep/k/~0", "[]"), ("a", "/deep/none", "null"), ("b", "", "null")}
    ids = {r["path"]: r["evidence_id"] for r in found.where("task = 'a'").collect()}
    assert len(set(ids.values())) == 5 and all(len(i) == 19 for i in ids.values())
    asked = spark.createDataFrame([("a", i) for p, i in ids.items() if p != "/x"] + [("a", "ev_gone"), ("c", ids["/x"])], "task string, evidence_id string")
    assert {tuple(r) for r in registry.closure(found.where("task = 'a'"), asked, "task").collect()} == {("a", "ev_gone", "dangling"), ("c", ids["/x"], "dangling"), ("a", ids["/x"], "orphan")}
    views = {r["task"]: (r["facts"], r["references"], r["dangling"], r["orphan"], r["closed"]) for r in registry.task_views(found, asked, "task").collect()}
    assert views == {"a": (5, 5, 1, 1, False), "b": (1, 0, 0, 1, False), "c": (0, 1, 1, 0, False)}
    twice = found.where("task = 'a'").union(found.where("path = '/x'"))
    assert ("a", ids["/x"], "ambiguous") in {tuple(r) for r in registry.closure(twice, asked, "task").collect()}


def test_pilot_close(spark):
    import hashlib

    text = '{"a":1,"b":[2]}'
    right = hashlib.sha256(text.encode()).hexdigest()
    runs = [("ok", "open", True), ("gates", "open", None), ("done", "closed", True), ("none", "open", True), ("null", "open", True), ("two", "open", True), ("twice", "open", True), ("changed", "open", True), ("broken", "open", True)]
    audits = [(p, '{"b": [2], "a": 1}', right) for p in ("ok", "gates", "done", "two", "two")] + [("twice", '{"a":1,"b":[2],"a":1}', right), ("changed", '{"a":1,"b":[3]}', right), ("broken", '{"a":1', right), ("null", None, right)]
    found = pilots.closed(spark.createDataFrame(runs, "project string, state string, verified boolean"), spark.createDataFrame(audits, "project string, audit string, digest string"))
    assert {r["project"]: r["outcome"] for r in found.collect()} == {
        "ok": "closed", "gates": "gates", "done": "not_open", "none": "missing_audit", "null": "missing_audit", "two": "ambiguous_audit", "twice": "ambiguous_audit", "changed": "changed_audit", "broken": "malformed_audit"}


def summed(facts):
    return facts.groupBy("root").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("facts"), F.sum("amount").alias("amount"))


SCHEMA = "event_key long, session long, parent long, amount long"


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number}")


def derive(spark, folder, summarise=summed):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    trees.rederive(stream, str(folder), f"{folder}/checkpoint", summarise, per_bucket=4)
    return {r["root"]: (r["sessions"], r["facts"], r["amount"]) for r in trees.summaries(spark, str(folder), "sessions long, facts long, amount long").collect()}


def test_late_facts_and_parents(spark, tmp_path):
    arrive(spark, tmp_path, 0, [(1, 10, None, 5), (2, 11, 10, 7), (3, 20, 19, 1), (4, 21, 20, 1), (5, 30, None, 9)])
    assert derive(spark, tmp_path) == {10: (2, 2, 12), 20: (2, 2, 2), 30: (1, 1, 9)}
    # the missing parent, a fact that is told again, and a session that moves with its child
    arrive(spark, tmp_path, 1, [(6, 19, 10, 100), (1, 10, None, 999)])
    assert derive(spark, tmp_path) == {10: (5, 5, 114), 30: (1, 1, 9)}
    # two parents are claimed for 20, so that it has none
    arrive(spark, tmp_path, 2, [(7, 20, 30, 3), (8, 40, 41, 1), (9, 41, 40, 1)])
    assert derive(spark, tmp_path) == {10: (3, 3, 112), 20: (2, 3, 5), 30: (1, 1, 9), 40: (2, 2, 2)}


def test_a_batch_that_fails_runs_again(spark, tmp_path):
    arrive(spark, tmp_path, 0, [(1, 10, None, 5), (2, 11, 10, 7)])
    derive(spark, tmp_path)
    arrive(spark, tmp_path, 1, [(3, 11, None, 2), (4, 12, 11, 1)])

    def broken(facts):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        derive(spark, tmp_path, broken)
    assert derive(spark, tmp_path) == {10: (3, 4, 15)}
    assert {(r["session"], r["root"]) for r in trees.members(spark, str(tmp_path)).collect()} == {(10, 10), (11, 10), (12, 10)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_read_each_table_once(spark):
    facts = registry.registered(spark.createDataFrame([("a", [1, 2])], "task string, report array<int>"), "task", "report")
    asked = spark.createDataFrame([("a", "ev_gone"), ("b", None)], "task string, evidence_id string")
    views = registry.task_views(facts, asked, "task")
    assert plan_of(views).count("Generate") == 1
    assert {tuple(r) for r in views.collect()} == {("a", 2, 1, 1, 2, 0, False), ("b", 0, 1, 1, 0, 0, False)}


def test_parts_are_laid_out_once_at_any_depth(spark):
    def calls(depth):
        kind = "array<" * depth + "int" + ">" * depth
        return plan_of(registry.registered(spark.createDataFrame([], f"task string, report {kind}"), "task", "report")).count("transform(")

    assert calls(6) <= 2 * calls(3)


def test_a_batch_of_a_stream_is_written_by_many_tasks(spark):
    import glob

    from evidentia.plans import incremental
    from evidentia.shipping import shared_folder

    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stream-*"))
    found = incremental.stream_trees(spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    (folder,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stream-*")) - before
    assert len(glob.glob(f"{folder}/in/*.parquet")) > 3 and len(glob.glob(f"{folder}/checkpoint/commits/[0-9]*")) == 3
