"""Stateful processors: queues of connections, decisions of traces, running latencies, with typed state
in the state store, event-time timers, and nothing read or written that a batch doesn't need.

A timer that runs out forgets its key. State has no time to live besides: that is a matter of processing
time, and these streams go by event time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.anomaly import FOLDED_SCHEMA, SAMPLE, Detector, State
from ..operators.correlate import FINISHED_SCHEMA, Connection, finished_row

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which typed state needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


class Timed(StatefulProcessor):
    """A key with one timer: every batch puts it off."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at_ms long")

    def put_off(self, last_ns: int, timer_values) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = max(int(last_ns) // 1_000_000 + self.idle_ms, timer_values.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class Correlator(Timed):
    """ST-01 to ST-07. State: the waiting requests as a list, the time of the last event, and how many wait, so that a batch of
    requests alone appends to the list without reading it."""

    def __init__(self, most: int, timeout_ns: int):
        super().__init__(timeout_ns // 1_000_000 + 1)
        self.most, self.timeout_ns = most, timeout_ns

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "conn_key string, kind string, ts_ns long, seq long, span_id string, trace_id string")
        self.last = handle.getValueState("last", "at_ns long, waiting int")

    @staticmethod
    def packed(e: dict) -> tuple:
        return (e["conn_key"], e["kind"], int(e["ts_ns"]), int(e["seq"]), e["span_id"], e["trace_id"])

    def queue(self) -> deque:
        return deque(dict(zip(("conn_key", "kind", "ts_ns", "seq", "span_id", "trace_id"), r, strict=True)) for r in self.waiting.get())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for f in rows for r in f.drop(columns="at").to_dict("records")), key=lambda r: (r["ts_ns"], r["seq"]))
        last_ns, n = self.last.get() if self.last.exists() else (None, 0)
        times = [e["ts_ns"] for e in events] if last_ns is None else [last_ns, *(e["ts_ns"] for e in events)]
        quiet = any(b - a > self.timeout_ns for a, b in zip(times, times[1:], strict=False))
        c = Connection(self.most, self.timeout_ns)
        c.active_ns = last_ns
        out = []
        if not quiet and n + len(events) <= self.most and all(e["kind"] == "request" for e in events):
            self.waiting.appendList([self.packed(e) for e in events])
            c.active_ns, n = times[-1], n + len(events)
        else:
            c.queue = self.queue() if n else deque()
            out = [f for e in events for f in c.see(e)]
            if c.queue:
                self.waiting.put([self.packed(e) for e in c.queue])
            elif n:
                self.waiting.clear()
            n = len(c.queue)
        self.last.update((int(c.active_ns), n))
        self.put_off(c.active_ns, timerValues)
        yield finished_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = Connection(self.most, self.timeout_ns)
        c.queue = self.queue() if self.last.exists() and self.last.get()[1] else deque()
        for state in (self.waiting, self.last, self.timer):
            state.clear()
        yield finished_frame(c.flush("connection_timeout"))


def finished_frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([finished_row(f) for f in out], columns=FINISHED_SCHEMA.names)


class Sampler(Timed):
    """SMP-04, SMP-08. State: whether the trace is kept, as its first span decided."""

    def __init__(self, columns: list[str], keep_minutes: int):
        super().__init__(keep_minutes * 60_000)
        self.columns = columns

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "kept boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["start_ns", "span_id"])
        if self.kept.exists():
            kept = self.kept.get()[0]
        else:
            kept = bool(frame["kept_by_rate"].iloc[0])
            self.kept.update((kept,))
        self.put_off(frame["start_ns"].max(), timerValues)
        yield frame[self.columns] if kept else frame[self.columns].iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.timer.clear()
        return iter(())


class Sent:
    """When an alert of a severity was last sent: a map in the state store, read where a batch has an anomaly."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, severity: str) -> bool:
        return self.state.containsKey((severity,))

    def __getitem__(self, severity: str) -> int:
        return self.state.getValue((severity,))[0]

    def __setitem__(self, severity: str, at_ns: int) -> None:
        self.state.updateValue((severity,), (int(at_ns),))


class Latencies(Timed):
    """A-01 to A-09. State: the sums and averages of the run, and the times of what was sent as a map."""

    RUN = "n long, total double, squares double, ewma double, var double, seen_ns long"

    def __init__(self, d: Detector):
        super().__init__(int(d.idle_s * 1000))
        self.d = d

    def init(self, handle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", self.RUN)
        self.sent = handle.getMapState("sent", "severity string", "at_ns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SAMPLE.split(", ")]
        fields = [c.split()[0] for c in self.RUN.split(", ")]
        s = State()
        if self.run.exists():
            for name, value in zip(fields, self.run.get(), strict=True):
                setattr(s, name, value)
        s.sent = Sent(self.sent)
        frame = pd.concat(list(rows)).sort_values(["start_ns", "span_id"])
        made = []
        for x, at in zip(frame["duration_ms"].tolist(), frame["start_ns"].tolist(), strict=True):
            made.append(s.add(self.d, x, at))
            if isinstance(s.sent, dict):  # a new run
                self.sent.clear()
                before, s.sent = s.sent, Sent(self.sent)
                for severity, sent_ns in before.items():
                    s.sent[severity] = sent_ns
        self.run.update(tuple(float(v) if kind == "double" else int(v) for v, kind in ((getattr(s, c.split()[0]), c.split()[1]) for c in self.RUN.split(", "))))
        self.put_off(frame["start_ns"].max(), timerValues)
        yield pd.concat([frame[names].reset_index(drop=True), pd.DataFrame(made)], axis=1)[[*names, *FOLDED_SCHEMA.names]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.run, self.sent, self.timer):
            state.clear()
        return iter(())
