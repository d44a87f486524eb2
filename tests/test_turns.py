"""The life of a turn over restarts of its stream."""

import datetime

import pytest

from evidentia.shipping import ship_package
from evidentia.streaming import turns

SCHEMA = "turn_key string, at timestamp, order long, kind string, capability string, expires timestamp, request string, sequence long, digest string, what string, retry_active boolean, retry_expires timestamp"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + datetime.timedelta(minutes=minutes)


def row(turn, minute, kind, capability=None, expires=None, request=None, sequence=None, digest=None, what=None, retry_active=None, retry_expires=None, order=0):
    return (turn, at(minute), order, kind, capability, at(expires), request, sequence, digest, what, retry_active, at(retry_expires))


def annotate(turn, minute, request, sequence, digest="d", what="note", capability="c", order=0):
    return row(turn, minute, "annotate", capability, request=request, sequence=sequence, digest=digest, what=what, order=order)


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], x[3]))


@pytest.fixture
def run(spark, tmp_path):
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", turns.STATE_STORE)
    number = iter(range(100))

    def go(rows):
        """What a stream that is started again tells of these rows."""
        n = next(number)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out" / str(n))
        told = turns.judged(stream, "1 minute", late_ms=600_000).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out))
        told.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return ordered((r["turn_key"], r["request"] or "", r["sequence"], r["outcome"]) for r in spark.read.schema(turns.OUT).parquet(out).collect())

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_turn_over_restarts(run):
    first = run([
        row("t", 0, "issue", "c", 30), annotate("t", 1, "r0", 0), annotate("t", 2, "r0", 0, order=1), annotate("t", 3, "r1", None), annotate("t", 4, "r1", 1, "other"), annotate("t", 5, "r2", 1), annotate("t", 6, "r3", 7),
        annotate("t", 7, "r4", 2, capability="stolen"), row("u", 0, "issue", "c", 5), row("v", 0, "issue", "c", 0)])
    assert first == ordered([
        ("t", "", None, "issued"), ("t", "r0", 0, "accepted"), ("t", "r0", 0, "retried"), ("t", "r1", 1, "accepted"), ("t", "r1", 1, "sequence_conflict"), ("t", "r2", 1, "sequence_conflict"), ("t", "r3", 7, "out_of_order"),
        ("t", "r4", 2, "unknown_capability"), ("u", "", None, "issued"), ("v", "", None, "invalid_expiry")])
    second = run([
        annotate("t", 31, "r9", 2), annotate("t", 32, "r1", 1), row("t", 33, "stop", retry_active=False, retry_expires=50), annotate("t", 40, "r9", 2, what="finish"), annotate("t", 41, "ra", 3),
        annotate("t", 42, "r9", 2, what="finish"), row("t", 43, "stop", retry_active=True), row("u", 33, "stop", retry_active=False), row("u", 34, "stop", retry_active=True), row("u", 35, "stop", retry_active=False),
        row("w", 35, "issue", "c", 36)])
    assert second == ordered([
        ("t", "r9", 2, "expired"), ("t", "r1", 1, "retried"), ("t", "", None, "retry_required"), ("t", "r9", 2, "accepted"), ("t", "ra", 3, "finished"), ("t", "r9", 2, "retried"), ("t", "", None, "finished"),
        ("u", "", None, "retry_required"), ("u", "", None, "self_report_missing"), ("u", "", None, "self_report_missing"), ("w", "", None, "issued")])
    # the watermark passes all expiries: one turn was never ended, and no state is left of any
    assert run([row("z", 200, "issue", "c", 300)]) == ordered([("z", "", None, "issued"), ("w", "", None, "turn_expired")])
    assert run([annotate("t", 201, "r1", 1), annotate("z", 202, "r", None)]) == ordered([("t", "r1", 1, "unknown_capability"), ("z", "r", 0, "accepted")])
