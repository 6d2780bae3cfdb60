"""Requests and responses of a connection, paired first in, first out.

`replay` works on stored events in parallel, with bounded queues and timeouts, from the sizes of the queues alone (see
queues.py); `pairs` and `orphans` are the same without bounds. `Connection` is the state machine event by event,
for streams and tests.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import queues

#: Requests in flight on a connection, and seconds of silence after which it is given up.
IN_FLIGHT, TIMEOUT_S = 1000, 30
UNBOUNDED, FOREVER_NS = 1 << 39, 1 << 62


def is_request(payload: Column) -> Column:
    """FLT-05: by the first bytes of a payload of at least four."""
    first = F.substring(payload, 1, 4)
    text = F.decode(first, "ISO-8859-1")
    return F.coalesce((F.length(payload) >= 4) & (text.rlike("^(GET|PUT|POST|DELE)") | text.startswith("*") | (F.hex(F.substring(payload, 1, 1)) == "00")), F.lit(False))


def is_response(payload: Column) -> Column:
    """FLT-06."""
    text = F.decode(F.substring(payload, 1, 4), "ISO-8859-1")
    return F.coalesce((F.length(payload) >= 4) & (text.rlike(r"^(HTTP|[+\-:$])") | (F.hex(F.substring(payload, 1, 1)) == "01")), F.lit(False))


def epochs(events: DataFrame) -> DataFrame:
    """ST-02, ST-06: events with the number of opens and closes of their connection so far."""
    so_far = Window.partitionBy("conn_key").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("epoch", F.sum(F.col("kind").isin("open", "close").cast("int")).over(so_far))


def replay(events: DataFrame, most: int = IN_FLIGHT, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """ST-01 to ST-07 over stored events: what each request and response came to, as the state machine below tells
    it. A connection may lie on any number of tasks. What is still in flight at the end has the tag in_flight;
    requests that an open replaces vanish."""
    found = queues.fates(events, most, int(timeout_s * 1e9))
    request = found.filter("is_request").drop("is_request", "tag")
    removal = found.filter("NOT is_request AND nr IS NOT NULL").select(F.col("conn_key").alias("conn"), F.col("nr").alias("of"), F.col("tag").alias("how"), F.col("span_id").alias("answer"), F.col("ts_ns").alias("answered_ns"))
    met = request.join(removal, F.col("conn_key").eqNullSafe(F.col("conn")) & (F.col("nr") == F.col("of")), "left")
    answered = F.col("of").isNotNull() & F.col("how").isNull()
    took = F.when(answered, (F.col("answered_ns") - F.col("ts_ns")) / 1e6).alias("duration_ms")
    tag = F.when(~answered, F.coalesce("how", F.lit("in_flight")))
    own = F.struct("span_id", F.lit("request").alias("kind"), F.lit(None).cast("string").alias("parent_span_id"), tag.alias("tag"))
    answer = F.struct(F.col("answer").alias("span_id"), F.lit("response").alias("kind"), F.col("span_id").alias("parent_span_id"), F.lit(None).cast("string").alias("tag"))
    both = met.filter(F.coalesce("how", F.lit("")) != queues.VANISHED).select("conn_key", "trace_id", took, F.explode(F.when(answered, F.array(own, answer)).otherwise(F.array(own))).alias("r"))
    orphan = found.filter("tag = 'orphan_response'")
    names = [c.split()[0] for c in FINISHED.split(", ")]
    none = lambda kind: F.lit(None).cast(kind)
    return both.select("conn_key", "r.span_id", "r.kind", "r.parent_span_id", "trace_id", "duration_ms", "r.tag").unionByName(
        orphan.select("conn_key", "span_id", F.lit("response").alias("kind"), none("string").alias("parent_span_id"), "trace_id", none("double").alias("duration_ms"), "tag")
    ).select(*names)


def pairs(events: DataFrame) -> DataFrame:
    """ST-03, JN-04: each response with the request it answers, whatever waits and however long."""
    found = queues.fates(events, UNBOUNDED, FOREVER_NS)
    request = found.filter("is_request").select(F.col("conn_key").alias("conn"), F.col("nr").alias("of"), F.col("span_id").alias("request_span"), "trace_id", F.col("ts_ns").alias("sent_ns"))
    response = found.filter("NOT is_request AND nr IS NOT NULL AND tag IS NULL").select("conn_key", "nr", F.col("span_id").alias("response_span"), F.col("ts_ns").alias("received_ns"))
    met = request.join(response, F.col("conn_key").eqNullSafe(F.col("conn")) & (F.col("nr") == F.col("of")))
    return met.select("conn_key", "request_span", "trace_id", "sent_ns", "response_span", "received_ns", ((F.col("received_ns") - F.col("sent_ns")) / 1e6).alias("duration_ms"))


def orphans(events: DataFrame) -> DataFrame:
    """ST-05."""
    return queues.fates(events, UNBOUNDED, FOREVER_NS).filter("tag = 'orphan_response'").select("conn_key", "span_id")


class Connection:
    """The state machine of one connection: ST-01 to ST-07, ST-10. Each event gives the spans that it
    finishes: (event, parent span, trace, duration in ns, tag)."""

    def __init__(self, most: int = IN_FLIGHT, timeout_ns: int = TIMEOUT_S * 10**9):
        self.most, self.timeout_ns, self.queue, self.active_ns = most, timeout_ns, deque(), None

    def flush(self, tag: str | None) -> list[tuple]:
        out = [(e, None, e["trace_id"], None, tag) for e in self.queue if tag]
        self.queue.clear()
        return out

    def expire(self, now_ns: int) -> list[tuple]:
        """ST-07: silence for the timeout gives up what is in flight."""
        return self.flush("connection_timeout") if self.active_ns is not None and now_ns - self.active_ns > self.timeout_ns else []

    def see(self, e: dict) -> list[tuple]:
        out = self.expire(e["ts_ns"])
        self.active_ns = e["ts_ns"]
        if e["kind"] == "open":
            self.flush(None)  # a new connection replaces the old; its requests vanish
        elif e["kind"] == "close":
            out += self.flush("connection_closed")
        elif e["kind"] == "request":
            if len(self.queue) >= self.most:
                old = self.queue.popleft()
                out.append((old, None, old["trace_id"], None, "evicted"))
            self.queue.append(e)
        elif self.queue:
            r = self.queue.popleft()
            took = e["ts_ns"] - r["ts_ns"]
            out += [(r, None, r["trace_id"], took, None), (e, r["span_id"], r["trace_id"], took, None)]
        else:
            out.append((e, None, e["trace_id"], None, "orphan_response"))
        return out


EVENT = "conn_key string, kind string, ts_ns long, seq long, span_id string, trace_id string"
FINISHED = "conn_key string, span_id string, kind string, parent_span_id string, trace_id string, duration_ms double, tag string"
FINISHED_SCHEMA = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.string()) for c in FINISHED.split(", ")])


def finished_row(f: tuple) -> dict:
    e, parent, trace, took, tag = f
    return dict(conn_key=e["conn_key"], span_id=e["span_id"], kind=e["kind"], parent_span_id=parent, trace_id=trace, duration_ms=None if took is None else took / 1e6, tag=tag)


def counters(finished: DataFrame) -> DataFrame:
    """ST-11."""
    tagged = lambda t: F.count_if(F.col("tag") == t)
    return finished.agg(F.count_if(F.col("parent_span_id").isNotNull()).alias("matched"), tagged("orphan_response").alias("orphans"), tagged("connection_closed").alias("closed"), tagged("connection_timeout").alias("timed_out"), tagged("evicted").alias("evicted"), tagged("in_flight").alias("in_flight"))


def with_trace_ids(spans: DataFrame) -> DataFrame:
    """ST-08, PRJ-02: spans without ids get ones from what tells them apart, with the tag timeout when the
    trace id was missing."""
    from ..functions.scalars import connection_trace_id, hashed_id

    missing = F.coalesce(F.col("trace_id"), F.lit("")) == ""
    own = connection_trace_id(*map(F.col, ("pid", "source_ip", "source_port", "dest_ip", "dest_port", "start_ns", "comm")))
    span = hashed_id(F.concat_ws(":", own, F.col("start_ns").cast("string")), 16)
    return spans.withColumns({"trace_id": F.when(missing, own).otherwise(F.col("trace_id")), "span_id": F.when(F.coalesce(F.col("span_id"), F.lit("")) == "", span).otherwise(F.col("span_id")), "late": missing})


def ages(events: DataFrame) -> DataFrame:
    """JN-05: how long each event's connection had been open, null before any open."""
    so_far = Window.partitionBy("conn_key").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("kind") == "open", F.col("ts_ns")), ignorenulls=True).over(so_far)
    return events.withColumn("conn_age_ms", (F.col("ts_ns") - opened) / 1e6)
