"""Files to facts, and the figures of two recorded sessions where they are at hand."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.shipping import ship_package
from evidentia.sources import ingest, rollout

KEY = b"k" * 32
#: A folder with <name>/*.jsonl and <name>-manifest.json.
RECORDED = os.environ.get("RECORDED_SESSIONS", "")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def line(second, kind, payload):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{second:02d}Z", "type": kind, "payload": payload})


def tokens(n):
    return {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": n // 10, "reasoning_output_tokens": 0}}}


def test_files_to_facts(spark, tmp_path):
    root = [
        line(0, "session_meta", {"id": "r", "timestamp": "2024-01-01T00:00:00Z"}), line(1, "turn_context", {"turn_id": "t"}), line(1, "event_msg", {"type": "task_started"}), line(5, "event_msg", tokens(100)),
        line(9, "event_msg", {"type": "task_complete"}), line(11, "event_msg", tokens(900)),
    ]
    child = [line(2, "session_meta", {"id": "c", "parent_thread_id": "r", "timestamp": "2024-01-01T00:00:02Z"}), line(2, "event_msg", tokens(40)), line(6, "event_msg", tokens(70))]
    (tmp_path / "rollout-r.jsonl").write_text("\n".join(root) + "\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "rollout-c.jsonl").write_bytes("\n".join(child).encode() + b"\n\xff\xfe broken\n\n" + line(7, "event_msg", tokens(999)).encode())
    facts = ingest.facts(spark, str(tmp_path), KEY)
    assert {tuple(r)[:2] for r in facts.sessions.collect()} == {("r", None), ("c", "r")}
    used = facts.usage().collect()
    assert [(r["root"], r["members"], r["recorded_input"], r["baseline_input"], r["unique_input"], r["wall_ms"], r["agent_ms"]) for r in used] == [("r", 2, 170, 40, 130, 9000, 13000)]
    assert {(r["code"], r["lines"]) for r in facts.diagnostics.collect()} == {("invalid_encoding", 1), ("malformed", 1)}
    assert [(r["session_id"], r["turn_id"], r["state"], r["wall_ms"]) for r in facts.attempts().collect()] == [("r", "t", "completed", 8000)]


def test_lines_of_many_splits_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" for i in range(1, 4001)) + "unfinished")
    (tmp_path / "b.jsonl").write_text("one\r\n\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = rollout.lines(spark, str(tmp_path), KEY).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r["ordinal"]: r["line"] for r in found if r["path"].endswith("a.jsonl")}
    assert a == {i: f"line {i}" for i in range(1, 4001)}
    assert {r["ordinal"]: r["line"] for r in found if r["path"].endswith("b.jsonl")} == {1: "one\r", 2: "", 3: "two"}


def call(second, name, call_id, **arguments):
    return line(second, "response_item", {"type": "function_call", "call_id": call_id, "name": name, "arguments": json.dumps(arguments)})


def output(second, call_id, **result):
    return line(second, "response_item", {"type": "function_call_output", "call_id": call_id, "output": json.dumps(result)})


def test_tools_tests_and_files(spark, tmp_path):
    ended = {"type": "patch_apply_end", "call_id": "p", "success": True, "duration": {"secs": 1, "nanos": 5_000_000}, "changes": {"/w/src/b.py": {}, "/etc/passwd": {}}}
    rows = [
        line(0, "session_meta", {"id": "s", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w"}), line(1, "turn_context", {"turn_id": "t"}),
        call(2, "exec_command", "c1", cmd="pytest -q"), output(4, "c1", exit_code=1, stdout="assert 1 == 2"),
        call(5, "apply_patch", "p", patch="*** Update File: src/a.py\n@@\n*** Add File: ../out.py\n"), line(6, "event_msg", ended),
        call(7, "exec_command", "c1", cmd="pytest -q"), output(9, "c1", exit_code=0), call(10, "exec_command", "c2", cmd="pytest -q"), output(11, "c2", exit_code=1, stderr="Connection refused"),
        call(12, "exec_command", "c3", cmd="pytest -q"), output(13, "c3", exit_code=0), call(14, "exec_command", "c4", cmd="cat src/a.py /w/x.txt"), output(15, "c4", exit_code=0),
        call(16, "exec_command", "c5", cmd="cat secret.txt"), output(17, "c5", exit_code=2), call(18, "view_image", "v", path="img/x.png"), output(19, "r", exit_code=0),
        line(20, "event_msg", {"type": "mcp_tool_call_end", "call_id": "m", "result": {"Err": "no"}}), line(21, "event_msg", {"type": "sub_agent_activity", "agent_thread_id": "child"}),
        call(22, "exec_command", "c6", cmd="pytest -q"),
    ]
    (tmp_path / "rollout-s.jsonl").write_text("\n".join(rows) + "\n")
    facts = ingest.facts(spark, str(tmp_path), KEY)
    spans = sorted(((r["tool"], r["category"], r["state"], r["latency_ms"]) for r in facts.spans.collect()), key=str)
    # the call id c1 is used twice: one span from its first start to its last end
    assert spans == sorted([
        ("exec_command", "tool", "success", 7000), ("apply_patch", "tool", "success", 1005), ("exec_command", "tool", "failed", 1000), ("exec_command", "tool", "success", 1000), ("exec_command", "tool", "success", 1000),
        ("exec_command", "tool", "failed", 1000), ("view_image", "tool", "unknown", None), ("function", "tool", "success", None), ("mcp", "tool", "failed", None), ("exec_command", "tool", "unknown", None)], key=str)
    tests = [(r["runner"], r["scope"], r["outcome"], r["cause"], r["retry"], r["attempt"]) for r in facts.tests.orderBy("attempt").collect()]
    assert tests == [("pytest", "full", "success", "none", "none", 1), ("pytest", "full", "failed", "infra_failure", "none", 2), ("pytest", "full", "success", "none", "infra_recovery", 3)]
    files = {(r["operation"], r["path"], r["tool"]) for r in facts.files.collect()}
    assert files == {("write", "src/a.py", "apply_patch"), ("write", "src/b.py", "apply_patch"), ("read", "img/x.png", "view_image")}  # a command with one unclear path tells nothing, nor does one that failed
    assert {(r["session_id"], r["parent_id"], r["parent_kind"], r["paths"]) for r in facts.sessions.collect()} == {("s", None, None, 1), ("child", "s", "inferred", 0)}


@pytest.mark.parametrize("output, want", [
    ('{"exit_code": 0}', (0, "success", "none", "complete")), ('{"exit_code": "0"}', (None, "unknown", "unknown", "result_without_exit")), ('{"exit_code": true}', (None, "unknown", "unknown", "result_without_exit")),
    ('{"exit_code": 3, "message": "No space LEFT"}', (3, "failed", "infra_failure", "complete")), ('[{"type": "input_text", "text": "{\\"exit_code\\": 1}"}, "words"]', (1, "failed", "product_failure", "complete")),
    ('[{"exit_code": 1}, {"exit_code": 0}]', (None, "unknown", "unknown", "conflicted")), ("[]", (None, "unknown", "unknown", "result_without_exit")), ("plain words", (None, "unknown", "unknown", "result_without_exit")),
    (None, (None, "unknown", "unknown", "result_without_exit")), ('{"exit_code": 1.5}', (None, "unknown", "unknown", "result_without_exit")),
])
def test_structured_results(spark, output, want):
    from evidentia.functions import text

    df = spark.createDataFrame([(output,)], "o string")
    found = df.select(*[v.alias(k) for k, v in text.structured_result(df["o"]).items()]).first()
    assert (found["exit_status"], found["outcome"], found["cause"], found["completeness"]) == want


def test_structured_results_of_long_texts(spark):
    """A text tells the cause wherever it says so, however long it is and in whichever form it comes."""
    from evidentia.functions import text

    infra, product = (3, "failed", "infra_failure", "complete"), (3, "failed", "product_failure", "complete")
    late = {f: json.dumps({"exit_code": 3, f: "é" * 5000 + "x Connection REFUSED y" + "é" * 5000}) for f in ("stdout", "stderr", "message", "output")}
    given = [(o, infra) for o in late.values()] + [(f'["words", {late["stderr"]}]', infra), (json.dumps([{"type": "input_text", "text": late["output"]}]), infra), (json.dumps([late["stdout"]]), infra)]
    given += [(json.dumps({"exit_code": 3, "stdout": "x" * n + "sandbox"}), infra) for n in (4089, 4090, 4095, 4096, 1_000_000)]
    # no word that only a cut would make
    given += [(json.dumps({"exit_code": 3, "stdout": "x" * 4091 + "timedly", "stderr": "out"}), product), (json.dumps({"exit_code": 3, "stdout": "x" * 9000}), product)]
    given += [(json.dumps({"exit_code": 0, "stdout": "x" * 9000 + "sandbox"}), (0, "success", "none", "complete"))]
    rows = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(given)], "i int, o string")
    longest = spark.range(1).select(F.lit(len(given)).alias("i"), F.concat(F.lit('{"exit_code":3,"stdout":"'), F.repeat(F.lit("x"), 21_000_000), F.lit('sandbox"}')).alias("o"))
    columns = lambda df: df.select("i", *[v.alias(k) for k, v in text.structured_result(df["o"]).items()])
    found = {r[0]: tuple(r)[1:] for r in columns(rows).collect() + columns(longest).collect()}
    assert found == dict(enumerate([w for _, w in given] + [infra]))


def test_odd_outputs_are_read_as_json_is(spark):
    from evidentia.functions import text

    given = [
        "{'exit_code': 1}", '{"exit_code": 1, "x": NaN}', '{"exit_code": 1, "x": Infinity}', "{exit_code: 1}", '{"exit_code": 01}', '{"exit_code": 1,}', '{"exit_code": 1', '{"exit_code": 1, "exit_code": 2}', '/**/{"exit_code": 1}',
        '{"exit_code": 1} x', '{"exit_code": 1e2}', '{"exit_code": 1.0}', '{"exit_code": 100000000000000000000}', '{"exit_code": 1, "stdout": "a\nb"}', '{"exit_code": null}', "null", "", " ", '"{\\"exit_code\\": 1}"', "[[1]]", None]
    rows = spark.createDataFrame([(o,) for o in given], "o string")
    found = rows.select("o", F.to_json(F.from_json("o", "variant", text.LONG_TEXTS)).alias("a"), F.to_json(F.try_parse_json("o")).alias("b")).collect()
    assert {r["o"]: r["a"] for r in found} == {r["o"]: r["b"] for r in found}


def test_parents_are_claims(spark, tmp_path):
    """Two files of a session that confirm different parents leave it without one; a root without an end is a task."""
    metas = [("a1/rollout-c.jsonl", "c", "p"), ("a2/rollout-c.jsonl", "c", "q"), ("rollout-p.jsonl", "p", None), ("rollout-q.jsonl", "q", None), ("rollout-o.jsonl", "o", "unknown")]
    for name, own, parent in metas:
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(line(0, "session_meta", {"id": own, "timestamp": "2024-01-01T00:00:00Z", **({"parent_thread_id": parent} if parent else {})}) + "\n" + line(3, "event_msg", tokens(10)) + "\n")
    facts = ingest.facts(spark, str(tmp_path), KEY)
    assert {(r["session_id"], r["parent_kind"]) for r in facts.sessions.collect()} == {("c", "ambiguous"), ("p", None), ("q", None), ("o", "confirmed")}
    used = {r["root"]: (r["status"], r["members"], r["unique_input"]) for r in facts.usage().collect()}
    assert used == {k: ("incomplete", 1, 10) for k in "cpqo"}


def test_a_file_is_numbered_and_filled_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [line(0, "session_meta", {"id": "s"})] + [line(1, "turn_context", {"turn_id": f"t{i}"}) if i % 9 == 0 else line(2, "event_msg", tokens(i)) for i in range(1, 60)]
    (tmp_path / "rollout-s.jsonl").write_text("\n".join(rows) + "\n" + "unfinished é")
    monkeypatch.setattr(rollout, "CHUNK_LINES", 4)
    monkeypatch.setattr(rollout, "BLOCK_LINES", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = rollout.lines(spark, str(tmp_path), KEY)
        assert lines.rdd.getNumPartitions() > 5
        filled = {r["ordinal"]: (r["at_session"], r["at_turn"]) for r in rollout.filled_forward(rollout.parse(lines)).collect()}
        ends = {r["ordinal"]: r["end_byte"] for r in rollout.byte_ends(spark, str(tmp_path)).collect()}
        blocks = rollout.block_digests(lines).collect()
        whole = rollout.file_digests(rollout.block_digests(lines)).collect()
        kept = lines.select("path", "ordinal", "fingerprint").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert filled == {i + 1: ("s", f"t{i // 9 * 9}" if i >= 9 else None) for i in range(60)}
    sizes = [len(r.encode()) + 1 for r in rows]
    assert ends == {i + 1: sum(sizes[: i + 1]) for i in range(60)}
    assert len(blocks) == 15 and [r["lines"] for r in whole] == [60]
    again = spark.createDataFrame(kept).repartition(7)
    assert rollout.file_digests(rollout.block_digests(again)).collect() == whole
    other = spark.createDataFrame([(p, o, "x" if o == 50 else f) for p, o, f in kept], "path string, ordinal long, fingerprint string")
    assert rollout.file_digests(rollout.block_digests(other)).first()["digest"] != whole[0]["digest"]


@pytest.mark.parametrize("old, new, want", [("abcde", "abcde", "exact"), ("abc", "abcdefg", "append"), ("abcdefg", "abcd", "truncate"), ("abxde", "abcdefg", "rewrite"), ("abcdx", "abcdefg", "rewrite"), ("abcd", "abcdefg", "append"), ("", "abc", "new"), ("ab", "", "gone")])
def test_relations_of_files(spark, monkeypatch, old, new, want):
    monkeypatch.setattr(rollout, "BLOCK_LINES", 4)
    a, b = (spark.createDataFrame([("f", i + 1, c) for i, c in enumerate(x)], "path string, ordinal long, fingerprint string") for x in (old, new))
    found = rollout.relations(a, b).collect()
    assert [(r["old_lines"], r["new_lines"], r["relation"]) for r in found] == [(len(old), len(new), want)]


if RECORDED:

    @pytest.mark.parametrize("name", ["newer", "older"])
    def test_recorded_sessions(spark, name):
        compare_recorded(spark, Path(RECORDED), name)


def test_own_recording(spark):
    """A small recording with its figures, worked out by hand: a replayed baseline, an epoch, a silent session, what comes after
    the end."""
    compare_recorded(spark, Path(__file__).parent / "recorded", "small")


def compare_recorded(spark, folder, name):
    want = json.loads((folder / f"{name}-manifest.json").read_text())
    facts = ingest.facts(spark, str(folder / name), KEY)
    got = next(r for r in facts.usage().collect() if r["root"] == want["root"])
    e = want["expected"]
    assert got["members"] == e["sessions"]
    assert [got[f"unique_{c}"] for c in ("input", "cached", "output", "reasoning")] == [e[c] for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")]
    assert (got["working"], got["full_context"]) == (e["working_tokens"], e["full_context"])
    assert (got["wall_ms"], got["agent_ms"]) == (round(want["wall_clock_seconds"] * 1000), round(want["agent_time_seconds"] * 1000))
    assert (got["observed_baselines"], got["zero_baselines"]) == (want["observed_replay_baselines"], want["zero_no_observation"])


def test_results_and_commands_are_parsed_once(spark):
    from evidentia.functions import commands, text

    df = spark.createDataFrame([('{"exit_code": 0}',)], "o string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    for value in text.structured_result(df["o"]).values():
        assert plan(value).count("parse_json(") + plan(value).count("parsejson(") <= 3
    assert plan(commands.shell_files(df["o"])).count("regexp_extract_all(") == 1


def test_results_are_read_once(spark):
    from evidentia.functions import text

    df = spark.createDataFrame([('{"exit_code": 0}',)], "o string")
    for value in text.structured_result(df["o"]).values():
        assert df.select(value.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(") == 3
