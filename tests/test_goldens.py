"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import commands, instants, keys, text
from evidentia.operators import arbitration, counters, facts, intervals, lineage, resolution, tree, turns
from evidentia.plans import texts
from evidentia.shipping import ship_package

S = 1_000_000_000
TOKENS = "session_id string, observed_ns long, sequence long, input long, cached long, output long, reasoning long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def usage(spark, sessions, tokens, activities, roots):
    return tree.usage(
        spark.createDataFrame([(s, p, a * S) for s, p, a in sessions], "session_id string, parent_id string, started_ns long"),
        spark.createDataFrame([(s, a * S, q, *v) for s, a, q, v in tokens], TOKENS),
        spark.createDataFrame([(s, a * S) for s, a in activities], "session_id string, observed_ns long"),
        spark.createDataFrame([(r, c * S) for r, c in roots], "root string, cutoff_ns long")).collect()


def test_cycle_and_cutoff(spark):
    r = usage(
        spark, [("root", "child", 0), ("child", "root", 2), ("late", "root", 11), ("other", None, 1)],
        [("root", 9, 1, (100, 20, 10, 5)), ("root", 12, 2, (900, 100, 90, 50)), ("child", 2, 1, (30, 10, 2, 1)), ("child", 8, 2, (50, 15, 4, 2)), ("late", 12, 1, (70, 10, 3, 1)), ("other", 5, 1, (80, 20, 2, 1))],
        [("root", 10), ("root", 12), ("child", 8), ("late", 12), ("other", 5)], [("root", 10)])[0]
    assert (r["members"], r["subagents"], r["cycle_edges"]) == (2, 1, 1)
    assert [r[f"recorded_{c}"] for c in tree.COMPONENTS] == [150, 35, 14, 7]
    assert [r[f"baseline_{c}"] for c in tree.COMPONENTS] == [30, 10, 2, 1]
    assert [r[f"unique_{c}"] for c in tree.COMPONENTS] == [120, 25, 12, 6]
    assert (r["working"], r["full_context"], r["wall_ms"], r["agent_ms"], r["provenance"]) == (107, 132, 10_000, 16_000, "derived")


def test_zero_baseline_and_reset(spark):
    rows = {r["root"]: r for r in usage(
        spark, [("a", None, 0), ("b", "a", 2), ("c", None, 0)],
        [("a", 9, 1, (10, 2, 3, 1)), ("b", 8, 1, (20, 5, 4, 2)), ("c", 2, 1, (100, 60, 10, 8)), ("c", 3, 2, (120, 70, 15, 9)), ("c", 4, 3, (20, 5, 3, 2)), ("c", 5, 4, (30, 8, 4, 3))],
        [("a", 10), ("b", 8), ("c", 6)], [("a", 10), ("c", 6)])}
    assert rows["a"]["caveats"] == ["zero_no_observation:1"] and rows["a"]["provenance"] == "estimated"
    assert [rows["c"][f"recorded_{c}"] for c in tree.COMPONENTS] == [150, 78, 19, 12]
    assert (rows["c"]["working"], rows["c"]["full_context"]) == (91, 169)


def test_partial_components(spark):
    df = spark.createDataFrame([("s", 1, 100, 20, 10, 3), ("s", 2, 120, None, 12, None), ("s", 3, 10, 2, 1, 1)], "k string, t long, input long, cached long, output long, reasoning long")
    found = counters.with_epochs_over_gaps(df, ["k"], ["t"], tree.COMPONENTS)
    assert [r["epoch"] for r in found.orderBy("t").collect()] == [0, 0, 1]
    totals = counters.final_totals(found, ["k"], ["t"], tree.COMPONENTS).first()
    assert totals["input"] - totals["cached"] + totals["output"] == 121


def test_attempts(spark):
    rows = [("started", 1, None, 1), ("completed", 3, 1500, 2), ("started", 4, None, 3), ("aborted", 5, 500, 4), ("started", 2, None, 5)]
    df = spark.createDataFrame([("s", "t", k, a * S, d, 3, "x", o) for k, a, d, o in rows], "session_id string, turn_id string, kind string, observed_ns long, duration_ms long, authority long, source string, ordinal long")
    assert [tuple(r)[2:6] for r in turns.attempts(df).orderBy("attempt").collect()] == [(1, "completed", 2000, 1500), (2, "aborted", 1000, 500)]


ODD = 1_700_000_000_123_456_789


def test_nanoseconds_stay_whole_beside_missing_instants(spark):
    events = [("s", "t", "started", ODD, None, 1, "a", 1), ("s", "t", "completed", ODD + 1_500_001, 7, 1, "a", 2), ("s", "t", "aborted", None, None, 2, "a", 3), (None, "t", "started", ODD + 2, None, 1, "a", 1)]
    schema = "session_id string, turn_id string, kind string, observed_ns long, duration_ms long, authority long, source string, ordinal long"
    found = {r["session_id"]: r for r in turns.attempts(spark.createDataFrame(events, schema)).where("attempt = 1").collect()}
    assert (found["s"]["started_ns"], found["s"]["finished_ns"], found["s"]["state"]) == (ODD, None, "aborted")
    assert (found[None]["started_ns"], found[None]["state"]) == (ODD + 2, "open")
    closed = turns.attempts(spark.createDataFrame(events[:2] + events[3:], schema)).where("session_id = 's'").collect()
    assert [(r["started_ns"], r["finished_ns"], r["wall_ms"], r["emitted_ms"]) for r in closed] == [(ODD, ODD + 1_500_001, 2, 7)]
    assert turns.attempts(spark.createDataFrame([], schema)).count() == 0


def test_epochs_over_gaps_keep_integers_and_put_missing_instants_last(spark):
    rows = [(1, ODD, 1, 5, None), (1, ODD + 1, 2, None, ODD), (1, None, 3, 1, None), (1, ODD + 2, 4, 7, ODD + 2), (None, ODD, 5, 3, None), (None, ODD + 1, 6, 2, None)]
    df = spark.createDataFrame(rows, "k long, at long, id long, a long, b long").repartition(3)
    found = counters.with_epochs_over_gaps(df, ["k"], ["at", "id"], ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(*r, e) for r, e in zip(rows, (0, 0, 1, 0, 0, 1))}
    whole = spark.createDataFrame([(1, None, 1, 5), (1, ODD, 2, 3), (1, ODD + 1, 3, 6)], "k long, at long, id long, a long")
    assert {(r["id"], r["epoch"]) for r in counters.with_epochs(whole, ["k"], ["at", "id"], ["a"]).collect()} == {(2, 0), (3, 0), (1, 1)}
    totals = counters.final_totals(counters.with_epochs(whole, ["k"], ["at", "id"], ["a"]), ["k"], ["at", "id"], ["a"]).collect()
    assert [(r["a"], r["epochs"]) for r in totals] == [(11, 2)]


def test_hints(spark):
    schema = "session_id string, event_key string, observed_ns long, input long, cached long, output long, reasoning long"
    deltas = spark.createDataFrame([("a", "d1", None, 10, 2, 3, 1), ("b", "d2", 5, 4, 0, 1, 0)], schema)
    hints = spark.createDataFrame([("a", "h1", 7, 6, 1, 2, 1), ("b", "h2", 8, 9, 0, 0, 0)], schema)
    found = {(r["event_key"], r["input"], r["origin"]) for r in tree.allocate_hints(deltas, hints).collect()}
    assert found == {("h1", 6, "hint"), ("residual:a", 4, "residual"), ("d2", 4, "delta")}


def test_trend(spark):
    rows = [("n", i, v) for i, v in enumerate([100, 110, 90, 100, 200])] + [("m", 0, 1), ("m", 1, 5)]
    found = {(r["k"], r["t"]): (r["twice_median"], r["warning"]) for r in facts.trend(spark.createDataFrame(rows, "k string, t long, v long"), ["k"], "t", "v").collect()}
    assert found[("n", 4)] == (200, True) and found[("m", 1)] == (None, False)


def test_roots_with_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 6), (8, 99), (9, 9)]
    found = {r["n"]: r["root"] for r in lineage.roots(spark.createDataFrame(rows, "n long, p long"), "n", "p").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 9}


def test_interval_edges(spark):
    events = spark.createDataFrame([(1, "u", 10), (2, "u", 20), (3, "u", 15), (4, "v", 10)], "id long, k string, t long")
    marks = spark.createDataFrame([("u", 10, 20, "a"), ("u", 12, None, "b"), ("u", 15, 15, "bad")], "k string, start long, end long, label string")
    found = {r["id"]: (r["label"], r["overlap"]) for r in intervals.attribute(events, marks, ["k"], "t", "id", 4).collect()}
    assert found == {1: ("a", False), 2: ("b", False), 3: ("b", True), 4: (None, False)}


def test_instants(spark):
    given = ["2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00.1234567Z", "2024-01-01t01:00:00+01:00", "2024-01-01T00:00:00-00:00", "2024-13-01T00:00:00Z", "2024-01-01T00:00:00", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i long, g string")
    ns = instants.epoch_ns(F.col("g"))
    rows = df.select(ns.alias("ns"), instants.canonical(ns).alias("c"), instants.quality(F.col("g")).alias("q")).orderBy("i").collect()
    base = 1704067200 * S
    assert [r["ns"] for r in rows] == [base + 123456789, base + 123456700, base, None, None, None, None]
    assert rows[1]["c"] == "2024-01-01T00:00:00.1234567Z" and rows[2]["c"] == "2024-01-01T00:00:00Z"
    assert [r["q"] for r in rows] == ["valid"] * 3 + ["invalid"] * 3 + ["missing"]


def test_keys(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(keys.hmac_sha256(F.lit("häm"), b"k" * 80).alias("h")).first()
    assert row["h"] == hmac.new(b"k" * 80, "häm".encode(), hashlib.sha256).hexdigest()


MORE_COMMANDS = {
    "PYTEST -q": "pytest full", "/usr/bin/python3.12 -m pytest -k 'a or b'": "pytest targeted", "pytest --tb short -q": "pytest full", "pytest --mark=slow": "pytest targeted",
    "python -m unittest discover": "unittest full", "python -m unittest tests.a": "unittest targeted", "python -m unittest -v": "unittest full", "python a.py": "unknown unknown",
    "go test ./pkg": "go targeted", "go test -run=TestA ./...": "go targeted", "cargo build": "unknown unknown", "cargo test name": "cargo targeted", "npm test": "npm full",
    "npm run test": "npm full", "yarn test src/a": "yarn targeted", "bun run build": "unknown unknown", "pnpm run test -- --grep=x": "pnpm targeted", "npm run tester": "unknown unknown",
    "gradle build": "unknown unknown", "gradle test": "gradle full", "gradle clean test --tests A": "gradle targeted", "mvn -Dtest=A test": "maven targeted", "mvn verify": "unknown unknown",
    "env A=1 uv run pytest": "pytest full", "env A=1 env B=2 env C=3 pytest": "unknown unknown", "bash -c 'sh -c pytest'": "pytest full", "sh -c pytest extra": "unknown unknown",
    "bash -lc pytest": "unknown unknown", "jest a.spec.ts": "jest targeted", "npx -y playwright test": "playwright full", "playwright show": "unknown unknown", "pytest 'a b": "unknown unknown",
    "pytest; ls": "unknown unknown", "pytest ';'": "pytest targeted", "": "unknown unknown", "swift test --filter=A": "swift targeted", "vitest run": "vitest full", "vitest -t x": "vitest targeted",
}
MORE_FILES = {
    "tail -n 3 -q 'a b.txt'": "read:a b.txt", "head -c5 x": "read:x", "rg -g a -e b c d": "read:d", "rg needle": "", "sed -n p": "", "cat -- -x": "", "cat ./a ././b": "read:a read:b", "cat a >> b": "read:a write:b",
    "cat a > ../b": "", "cat ~/a": "", "cat C:/a": "", "cat a > b > c": "", "grep a b": "", "cat": "", "sed -i.bak s/a/b/ x y": "write:x write:y",
}


def test_commands(spark):
    given = {**texts.COMMANDS, **MORE_COMMANDS}
    rows = commands.test_command(spark.createDataFrame([(c,) for c in [*given, None]], "command string"), "command").collect()
    assert {r["command"]: f"{r['runner']} {r['scope']}" for r in rows} == {**given, None: "unknown unknown"}
    given = {**texts.FILES, **MORE_FILES}
    files = F.transform(commands.shell_files(F.col("command")), lambda f: F.concat_ws(":", f["op"], f["path"]))
    rows = spark.createDataFrame([(c,) for c in [*given, None]], "command string").select("command", F.concat_ws(" ", files).alias("files")).collect()
    assert {r["command"]: r["files"] for r in rows} == {**given, None: ""}


def test_redaction(spark):
    given = {"a  plain\nnote": "a plain note", "a\u00a0\u2003b\u3000": "a b", "mail me@x.org": "[redacted]", "see /home/me": "[redacted]", "": "[redacted]", "password: x": "[redacted]", "call 030 1234 5678 90": "[redacted]"}
    rows = spark.createDataFrame(list(given.items()), "t string, want string").select(text.redacted(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_outcomes(spark):
    rows = spark.createDataFrame([(0, "x"), (2, "assertion failed"), (1, "Sandbox unavailable"), (None, "x")], "e int, d string")
    o = text.structured_outcome(F.col("e"), F.col("d"))
    assert [tuple(r) for r in rows.select(o["outcome"], o["cause"]).collect()] == [("success", "none"), ("failed", "product_failure"), ("failed", "infra_failure"), ("unknown", "unknown")]


def test_parents(spark):
    rows = [("a", "p", "confirmed"), ("a", "q", "inferred"), ("b", "p", "confirmed"), ("b", "q", "confirmed"), ("c", "p", "inferred"), ("d", "p", "confirmed"), ("d", "p", "ambiguous"), ("e", "p", "inferred"), ("e", "q", "inferred")]
    found = {r["c"]: (r["parent"], r["confidence"]) for r in arbitration.resolve_parents(spark.createDataFrame(rows, "c string, p string, k string"), "c", "p", "k").collect()}
    assert found == {"a": ("p", 1.0), "b": (None, 0.0), "c": ("p", 0.6), "d": (None, 0.0), "e": (None, 0.0)}


def test_states_and_own_calls(spark):
    rows = spark.createDataFrame([("turn_completed", "inProgress"), ("turn_completed", "interrupted"), ("user_prompt", None), ("other", "odd")], "kind string, state string")
    found = rows.select(text.status(F.col("state")).alias("s"), text.lifecycle(F.col("kind"), text.status(F.col("state"))).alias("l")).collect()
    assert [tuple(r) for r in found] == [("in_progress", "completed"), ("interrupted", "aborted"), ("unknown", "started"), ("unknown", None)]
    given = {"observer report x": True, "A=1 /usr/bin/observer audit": True, "env A=b python3.12 -m observer_pkg report": True, "observer": False, "observer other": False, "observer report; ls": False, None: False}
    got = spark.createDataFrame([(c,) for c in given], "c string").select("c", commands.calls(F.col("c"), "observer", "observer_pkg", ["report", "audit"]).alias("own")).collect()
    assert {r["c"]: r["own"] for r in got} == given


def test_labels_and_inserts(spark):
    labels = {" Fix  the cli ": "Fix the cli", "task_0123abcd": None, "see hprj_v12345678": None, "a/b": None, "x" * 81: None, "token: y": None, "file:x": None, "a..b": None, "‮ab": None}
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select("x", resolution.label(F.col("x")).alias("label")).collect()
    assert {r["x"]: r["label"] for r in rows} == labels
    known = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, c string")
    arriving = spark.createDataFrame([(1, "a"), (1, "x"), (3, "n"), (3, "n"), (3, "m"), (2, "b")], "k long, c string")
    outcomes = sorted((r["k"], r["outcome"]) for r in arbitration.split_inserts(known, arriving, "k", ["c"]).collect())
    assert [x for x in outcomes if x[0] != 3] == [(1, "conflicting"), (1, "duplicate"), (2, "duplicate")]
    assert [o for k, o in outcomes if k == 3].count("inserted") == 1 and len(outcomes) == 6


def test_overlapping_and_long_intervals(spark):
    """Against every interval tried for every event, by instants and by positions."""
    rnd = random.Random(6)
    marks = [(rnd.randrange(3), s := rnd.randrange(200), rnd.randrange(4), None if rnd.random() < 0.1 else s + rnd.choice([3, 10, 150]), rnd.randrange(4), f"l{i}") for i in range(40)] + [(None, 0, 0, None, 0, "null key")]
    events = [(rnd.choice([0, 1, 2, 3, None]), rnd.randrange(-5, 260), rnd.randrange(4), i) for i in range(400)] + [(1, None, 0, 1000)]
    iv = spark.createDataFrame(marks, "k int, start long, start_seq long, end long, end_seq long, label string")
    ev = spark.createDataFrame(events, "k int, at long, seq long, id long")
    found = {r["id"]: (r["label"], r["overlap"]) for r in intervals.attribute(ev, iv, ["k"], "at", "id", 50).collect()}
    placed = {r["id"]: r["label"] for r in intervals.attribute_by_position(ev, iv, ["k"], "at", "seq", "id").collect()}
    assert len(found) == len(placed) == len(events)
    for k, at, seq, i in events:
        held = [] if at is None or k is None else [(s, label) for mk, s, _, e, _, label in marks if mk == k and s <= at and (e is None or at < e)]
        assert found[i] == ((max(held)[1], len(held) > 1) if held else (None, False))
        first = [] if at is None or k is None else [(s, q, label) for mk, s, q, e, eq, label in marks if mk == k and (s, q) <= (at, seq) and (e is None or (at, seq) < (e, eq))]
        assert not first or placed[i] in {x[2] for x in first if x[:2] == min(first)[:2]}
        assert first or placed[i] is None


@pytest.mark.parametrize("most", [0, 10_000])
def test_descendants_of_sent_and_dealt_tables(spark, monkeypatch, most):
    from evidentia.operators import lineage

    monkeypatch.setattr(lineage, "MOST_SENT", most)
    nodes = spark.createDataFrame([(i, i // 2) for i in range(2, 40)] + [(1, 30)], "n long, p long")  # 1 closes a cycle
    found = lineage.descendants(nodes, "n", "p", spark.createDataFrame([(1,)], "root long"), F.lit(True)).collect()
    assert {(r["node"], r["depth"]) for r in found} == {(i, i.bit_length() - 1) for i in range(1, 40)}
    joined = lineage.sent(nodes, nodes.count()).join(nodes.select("n"), "n")._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in joined) == (most > 0)


def test_families_are_zipped_in_tasks_of_bounded_size(spark, monkeypatch):
    from evidentia.operators import arbitration

    rows = spark.createDataFrame([(k, 5, fam, n, 7) for k in range(50) for fam in (1, 2) for n in range(2)], "k long, m long, fam long, n int, d long")
    monkeypatch.setattr(arbitration, "ROWS_PER_TASK", 10)
    found = arbitration.zip_families(rows, ["k"], "m", "fam", ["n", "d"], "d")
    assert found.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, found.collect())) == sorted((k, 5, 2, 7, 2) for k in range(50) for _ in range(2))


def test_sessions_are_read_once_for_a_tree(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    sessions = spark.createDataFrame([(i, i // 2 or None, None) for i in range(1, 9)], "session_id long, parent_id long, started_ns long")
    found = tree.members(sessions.withColumn("session_id", seen.asNondeterministic()("session_id")), spark.createDataFrame([(1, 10)], "root long, cutoff_ns long"))
    assert found.count() == 8 and read.value == 8
