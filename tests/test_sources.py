"""Readers over files with every kind of odd line."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.shipping import ship_package
from evidentia.sources import exports, rollout
from evidentia.streaming import incremental

KEY = b"k" * 32


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def line(kind, payload, at="2024-01-01T00:00:00Z"):
    return json.dumps({"timestamp": at, "type": kind, "payload": payload})


def test_session_files(spark, tmp_path):
    tokens = {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5, "cached_input_tokens": 2, "output_tokens": 1, "reasoning_output_tokens": 0}}}
    rows = [
        line("session_meta", {"id": "other", "timestamp": "2024-01-01T00:00:00Z"}), line("session_meta", {"id": "abc", "parent_thread_id": "p"}), line("turn_context", {"turn_id": "t1"}),
        line("event_msg", tokens), line("event_msg", {"type": "agent_message"}), line("event_msg", {"type": "novel"}), line("response_item", {"type": "novel"}), line("novel", {}),
        "{broken", "[1]", line("event_msg", {"type": "task_started"}, "2024-01-01T00:00:00"), line("event_msg", 5),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "rollout-abc.jsonl").write_text("\n".join(rows) + "\n" + "unfinished")
    (tmp_path / "note.txt").write_text("no\n")
    parsed = rollout.parse(rollout.lines(spark, str(tmp_path), KEY)).orderBy("ordinal").collect()
    assert [r["route"] for r in parsed] == [
        "session_meta", "session_meta", "turn_context", "event_msg/token_count", "ignored", "unknown_event_type", "unknown_response_type", "unknown_envelope", "malformed", "malformed", "event_msg/task_started", "malformed"]
    assert [r["quality"] for r in parsed][10] == "invalid" and len({r["fingerprint"] for r in parsed}) == 12
    frame = rollout.parse(rollout.lines(spark, str(tmp_path), KEY))
    headers = rollout.session_headers(frame)
    assert headers.select("session_id", "parent_id").collect() == [("abc", "p")]
    snap = rollout.token_snapshots(frame, headers, KEY).first()
    assert (snap["input"], snap["cached"], snap["complete"], snap["session_id"]) == (5, 2, True, "abc")
    filled = {r["ordinal"]: (r["at_session"], r["at_turn"]) for r in rollout.filled_forward(frame).collect()}
    assert filled[1] == ("other", None) and filled[4] == ("abc", "t1")


def test_relations(spark):
    rows = [([1, 2], [1, 2], "exact"), ([1], [1, 2], "append"), ([1, 2], [1], "truncate"), ([1, 3], [1, 2], "rewrite"), ([], [1], "append")]
    df = spark.createDataFrame(rows, "o array<int>, n array<int>, want string")
    assert all(r["got"] == r["want"] for r in df.select(rollout.relation(F.col("o"), F.col("n")).alias("got"), "want").collect())


def test_app_server(spark):
    message = lambda method, **params: {"received_at": "2024-01-01T00:00:09Z", "message": {"method": method, "params": params}}
    given = [
        message("thread/started", thread={"id": "s", "createdAt": 100}), message("turn/completed", threadId="s", turn={"id": "t", "status": "completed", "completedAt": 200, "durationMs": 7}),
        message("thread/tokenUsage/updated", threadId="s", tokenUsage={"total": {"inputTokens": 5, "cachedInputTokens": 1, "outputTokens": 2, "reasoningOutputTokens": 0}}),
        message("item/completed", threadId="s", turnId="t", item={"id": "c", "type": "commandExecution", "status": "completed", "exitCode": 1, "aggregatedOutput": "é"}, completedAtMs=300),
        message("thread/other", threadId="s"), message("turn/started", turn={"id": "t"}),
        message("thread/tokenUsage/updated", threadId="s", tokenUsage={"total": {"inputTokens": 1, "cachedInputTokens": 4}}), message("thread/started", thread={"id": "s", "createdAt": 100})["message"],
    ]
    df = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)] + [(8, "{x")], "i int, line string")
    rows = exports.app_server(df, KEY).orderBy("i").collect()
    assert [r["issue"] for r in rows] == [None, None, None, None, "unknown_method", "missing_session", "invalid_tokens", None, "malformed_json"]
    assert [r["observed_ns"] for r in rows[:4]] == [100 * 10**9, 200 * 10**9, 1704067209 * 10**9, 300 * 10**6]
    assert rows[2]["input"] == 5 and rows[3]["exit_code"] == 1 and rows[3]["output"]["utf8_bytes"] == 2 and rows[3]["output"]["characters"] == 1
    assert len({r["session_key"] for r in rows[:4]}) == 1 and rows[7]["session_key"] == rows[0]["session_key"]


def test_otel(spark):
    record = lambda attrs, name="sse_event": {"timeUnixNano": "1704067200000000001", "body": {"stringValue": name}, "attributes": [{"key": k, "value": v} for k, v in attrs]}
    given = [
        record([("conversation.id", {"stringValue": "s"}), ("input_tokens", {"intValue": "5"}), ("output_tokens", {"intValue": "2"})]),
        record([("conversation.id", {"stringValue": "s"}), ("conversation.id", {"stringValue": "s"})]), record([("conversation.id", {"stringValue": "s", "intValue": "1"})]), record([("x", {"boolValue": True})]),
    ]
    df = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)], "i int, line string")
    rows = exports.otel(df, KEY).orderBy("i").collect()
    assert [r["issue"] for r in rows] == [None, "duplicate_attribute", "invalid_attribute", "missing_session"]
    assert (rows[0]["input"], rows[0]["output"], rows[0]["observed_ns"]) == (5, 2, 1704067200000000001)


def test_annotation_stream(spark, tmp_path):
    rows = [("t", 1, "a", "x", "phase"), ("t", 2, "b", "y", "phase"), ("t", 2, "b", "y", "phase"), ("t", 3, "c", "z", "finish"), ("t", 4, "d", "z", "phase"), ("u", 5, "e", "x", "phase"), ("u", 5, "f", "x", "phase")]
    schema = "turn_key string, sequence long, request string, digest string, kind string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    incremental.judge_annotations(stream).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["turn_key"], r["sequence"], r["request"], r["outcome"]) for r in spark.table("judged").collect())
    assert found == [("t", 1, "a", "accepted"), ("t", 2, "b", "accepted"), ("t", 2, "b", "retry"), ("t", 3, "c", "accepted"), ("t", 4, "d", "stopped"), ("u", 5, "e", "accepted"), ("u", 5, "f", "conflict")]


def test_a_message_is_judged_once(spark):
    df = spark.createDataFrame([(1, "{}")], "i int, line string")
    plan = exports.app_server(df, KEY)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json(") + plan.count("parsejson(") <= 2
