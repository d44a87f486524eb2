"""Annotations of turns under capabilities that expire: state per turn that ends by itself.

A turn's events (turn_key, at, order, kind) are, in the order of their instants and `order`:
  issue     capability and expires: from now on, until then, it may be annotated with.
  annotate  capability, request, sequence, digest and what: one more annotation. The same request again, with the same
            sequence and digest, is a retry and changes nothing, even after the turn has ended; another sequence or
            digest under a known request, or another request under a known sequence, conflicts. The next sequence is
            the last one and one; a null sequence means that. What is `finish` ends the turn.
  stop      the turn stops: it has finished; or is asked to report itself, once, by an expiry that may be set anew;
            and a stop that comes while it is asked (retry_active) ends it without a report.

The state of a turn holds its receipts only as long as a late retry may come: LATE_MS after the last expiry, when the
watermark has passed it, a timer ends the turn and clears all of it. A turn that was never ended is told as expired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "turn_key string, at timestamp, request string, sequence long, outcome string"
LATE_MS = 3_600_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at) -> int | None:
    return None if at is None or pd.isna(at) else int(pd.Timestamp(at).value // 1_000_000)


def _text(value) -> str | None:
    return None if value is None or pd.isna(value) else str(value)


class Turns(StatefulProcessor):
    def __init__(self, late_ms: int) -> None:
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "last long, last_at long, state string, stopped long, ends long")
        self.capabilities = handle.getMapState("capabilities", "capability string", "issued long, expires long, revoked boolean")
        self.requests = handle.getMapState("requests", "request string", "sequence long, digest string")
        self.sequences = handle.getMapState("sequences", "sequence long", "request string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        last, last_at, state, stopped, ends = self.turn.get() if self.turn.exists() else (-1, None, "open", None, 0)
        before = ends
        for row in pd.concat(list(rows)).sort_values(["at", "order"], kind="stable").itertuples(index=False):
            at, request = _ms(row.at), _text(row.request)
            sequence = None if pd.isna(row.sequence) else int(row.sequence)
            if row.kind == "issue":
                expires = _ms(row.expires)
                outcome = "finished" if state != "open" else "invalid_expiry" if expires is None or expires <= at else "issued"
                if outcome == "issued":
                    self.capabilities.updateValue((row.capability,), (at, expires, False))
                    ends = max(ends, expires)
            elif row.kind == "annotate":
                outcome, sequence = self._annotated(row, at, request, sequence, last, last_at, state)
                if outcome == "accepted":
                    last, last_at = sequence, at
                    state = "finished" if row.what == "finish" else state
            else:
                outcome = self._stopped(row, at, state, stopped, last_at)
                if outcome in ("retry_required", "self_report_missing") and state == "open":
                    stopped = at if stopped is None else stopped
                    again = _ms(row.retry_expires)
                    if outcome == "self_report_missing":
                        state = "unreported"
                        self._each(lambda c: (c[0], c[1], True))
                    elif again is not None and again > at:
                        self._each(lambda c, again=again: c if c[2] else (c[0], again, False))
                        ends = max(ends, again)
            found.append((key[0], row.at, request, sequence, outcome))
        ends = max(ends, max((_ms(f[1]) for f in found), default=0)) if not ends else ends
        self.turn.update((last, last_at, state, stopped, ends))
        if ends != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends + self.late_ms)
        yield pd.DataFrame(found, columns=["turn_key", "at", "request", "sequence", "outcome"]).astype({"sequence": "Int64"})

    def _each(self, change) -> None:
        for (name,), value in list(self.capabilities.iterator()):
            self.capabilities.updateValue((name,), change(value))

    def _annotated(self, row, at, request, sequence, last, last_at, state) -> tuple[str, int | None]:
        if not self.capabilities.containsKey((row.capability,)):
            return "unknown_capability", sequence
        issued, expires, revoked = self.capabilities.getValue((row.capability,))
        if at < issued:
            return "before_issue", sequence
        told = self.requests.getValue((request,)) if self.requests.containsKey((request,)) else None
        if sequence is None:
            sequence = told[0] if told else last + 1
        if told and told[0] == sequence and told[1] == row.digest:
            return "retried", sequence
        if state != "open" or revoked:
            return "finished", sequence
        if at >= expires:
            return "expired", sequence
        if self.sequences.containsKey((sequence,)):
            return "sequence_conflict", sequence
        if told:
            return "request_conflict", sequence
        if sequence != last + 1 or (last_at is not None and at < last_at):
            return "out_of_order", sequence
        self.requests.updateValue((request,), (sequence, row.digest))
        self.sequences.updateValue((sequence,), (request,))
        return "accepted", sequence

    def _stopped(self, row, at, state, stopped, last_at) -> str:
        if any(floor is not None and at < floor for floor in (stopped, last_at)):
            return "out_of_order"
        if state == "finished":
            return "finished"
        return "self_report_missing" if state != "open" or bool(row.retry_active) else "retry_required"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, ends = (self.turn.get()[2], self.turn.get()[4]) if self.turn.exists() else ("gone", 0)
        known = any(True for _ in self.capabilities.iterator())  # else nothing was ever issued for it
        for part in (self.turn, self.capabilities, self.requests, self.sequences):
            part.clear()
        rows = [(key[0], pd.Timestamp(ends, unit="ms"), None, None, "turn_expired")] if state == "open" and known else []
        yield pd.DataFrame(rows, columns=["turn_key", "at", "request", "sequence", "outcome"]).astype({"sequence": "Int64", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def judged(stream: DataFrame, watermark: str = "10 minutes", late_ms: int = LATE_MS) -> DataFrame:
    """turn_key, at, request, sequence, outcome of every event, and a row for each turn that expires. The session's state
    store has to be the one for stateful processors (STATE_STORE)."""
    return stream.withWatermark("at", watermark).groupBy("turn_key").transformWithStateInPandas(Turns(late_ms), OUT, "append", "eventTime")
