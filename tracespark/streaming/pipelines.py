"""Structured Streaming: correlation, sampling, rollups, the service map, anomalies, alert and span sinks.

State is kept by key in the state store (see stateful.py), time is event time, late rows are bounded by watermarks;
sources hold back instead of dropping."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.anomaly import KEY, SAMPLE, Detector
from ..operators.correlate import FINISHED, IN_FLIGHT, TIMEOUT_S
from ..operators.sampling import Rates, keeps, rate, rated
from ..operators.search import has_parent, is_error
from ..operators.stats import SKETCHED, sketch, sketched_quantiles
from ..schema import RAW_SIZE
from ..sources.tables import is_good, with_retries, write_spans
from .stateful import Correlator, Latencies, Sampler, state_store  # noqa: F401


def correlated(events: DataFrame, most: int = IN_FLIGHT, timeout_s: float = TIMEOUT_S, late: str = "30 seconds") -> DataFrame:
    """ST-01 to ST-07, JN-04: finished spans of each connection. events: conn_key, kind, ts_ns, seq,
    span_id, trace_id. A connection that stays silent past the timeout is flushed by an
    event-time timer."""
    timed = events.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", late)
    return by_key(timed, ["conn_key"], Correlator(most, int(timeout_s * 1e9)), FINISHED)


def by_key(timed: DataFrame, keys: list[str], processor: StatefulProcessor, schema) -> DataFrame:
    """The rows of each key through a processor. The session's state store has to be RocksDB: state_store(spark)."""
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def watermarked(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("__at", F.timestamp_micros(F.expr("start_ns div 1000"))).withWatermark("__at", late)


def sampled(spans: DataFrame, r: Rates = Rates(), keep_minutes: int = 10, late: str = "1 minute") -> DataFrame:
    """SMP-04, SMP-08: the first span seen of a trace decides for it; decisions are forgotten after some
    minutes without a span."""
    marked = watermarked(spans.withColumn("kept_by_rate", keeps(rate(r))), late)
    return by_key(marked, ["trace_id"], Sampler(spans.columns, keep_minutes), spans.schema)


def anomalies(spans: DataFrame, d: Detector = Detector(), late: str = "1 minute") -> DataFrame:
    """A-01 to A-09: every sample with the state after it; idle keys are forgotten."""
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    schema = f"{SAMPLE}, n long, mean double, stddev double, ewma double, ewma_var double, threshold double, deviation double, is_anomaly boolean, severity string, is_sent boolean"
    return by_key(watermarked(spans.filter("duration_ms > 0").select(*names), late), KEY, Latencies(d), schema)


def stats_rollup(spans: DataFrame, late: str = "2 minutes") -> DataFrame:
    """AGG-03, ST-12: minutes, given out once the watermark has passed them. Quantiles come from
    sketches of bounded size, kept as durations, so that operators.stats.merged_stats merges the minutes."""
    w = F.window("start_time", "1 minute")
    found = (
        spans.withColumn("start_time", F.col("start_time").cast("timestamp"))
        .withWatermark("start_time", late)
        .groupBy(w, "service_name", "operation", "protocol")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            F.count_if(is_error()).alias("error_count"),
            F.sum("duration_ms").alias("sum_duration_ms"),
            F.min("duration_ms").alias("min_duration_ms"),
            F.max("duration_ms").alias("max_duration_ms"),
            F.sum("payload_size").alias("total_payload_size"),
            sketch(),
        )
        .withColumns(sketched_quantiles(*SKETCHED))
    )
    return found.select(F.unix_micros("window.start").alias("minute_us"), "*").drop("window").withColumn("avg_duration_ms", F.col("sum_duration_ms") / F.col("call_count"))


def map_rollup(spans: DataFrame, late: str = "2 minutes", apart: str = "10 minutes") -> DataFrame:
    """AGG-04: edges by the minute; a child waits for its parent, and the other way round, so long.
    Edges whose spans start further apart are not in it: call_sink keeps them for a batch job to complete."""
    timed = spans.withColumn("start_time", F.col("start_time").cast("timestamp"))
    child = timed.filter(has_parent()).withWatermark("start_time", late).select("trace_id", F.col("parent_span_id").alias("of"), F.col("service_name").alias("source_service"), "protocol", "duration_ms", "error_code", F.col("start_time").alias("child_time"))
    parent = timed.withWatermark("start_time", late).select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("service_name").alias("dest_service"), F.col("start_time").alias("parent_time"))
    near = F.expr(f"parent_time BETWEEN child_time - INTERVAL {apart} AND child_time + INTERVAL {apart}")
    edges = child.join(parent, (F.col("trace_id") == F.col("t")) & (F.col("of") == F.col("s")) & near)
    found = edges.groupBy(F.window("child_time", "1 minute"), "source_service", "dest_service", "protocol").agg(F.count(F.lit(1)).alias("call_count"), F.count_if(is_error()).alias("error_count"), F.sum("duration_ms").alias("sum_duration_ms"), *[F.percentile_approx("duration_ms", p, 10_000).alias(f"{n}_duration_ms") for n, p in (("p95", 0.95), ("p99", 0.99))])
    return found.select(F.unix_micros("window.start").alias("minute_us"), "*").drop("window").withColumn("avg_duration_ms", F.col("sum_duration_ms") / F.col("call_count"))


CALL = ["trace_id", "span_id", "source_service", "dest_service", "protocol", "duration_ms", "error_code", "start_ns"]


def calls(spans: DataFrame, late: str = "2 minutes", apart: str = "10 minutes") -> DataFrame:
    """JN-01 over a stream: every child span with the service of its parent; dest_service is null once the watermark tells
    that no parent came within that time of it."""
    timed = spans.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", late)
    child = timed.filter(has_parent()).select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("service_name").alias("source_service"), "protocol", "duration_ms", "error_code", "start_ns", F.col("start_time").alias("child_time"))
    parent = timed.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("service_name").alias("dest_service"), F.col("start_time").alias("parent_time"))
    near = F.expr(f"parent_time BETWEEN child_time - INTERVAL {apart} AND child_time + INTERVAL {apart}")
    return child.join(parent, (F.col("trace_id") == F.col("t")) & (F.col("span_id") == F.col("s")) & near, "leftOuter").select(*CALL)


def call_sink(spans: DataFrame, path: str, checkpoint: str, late: str = "2 minutes", apart: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """AGG-04 without lost edges: calls under a path, those without a parent so far apart from the others. A batch
    that is repeated overwrites what it wrote."""

    def write(df, batch):
        told = df.withColumns({"is_met": F.col("dest_service").isNotNull(), "batch": F.lit(batch)})
        told.write.mode("overwrite").partitionBy("is_met", "batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    writer = calls(spans, late, apart).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def completed_calls(stored: DataFrame, spans: DataFrame) -> DataFrame:
    """Batch: what call_sink stored, where calls without a parent look for it among all spans; for
    operators.stats.rollup_of_calls. Those that have none there are no edges."""
    met = stored.filter(F.col("is_met").cast("boolean")).select(*CALL)
    parent = spans.select("trace_id", "span_id", F.col("service_name").alias("dest_service"))
    found = stored.filter(~F.col("is_met").cast("boolean")).select(*[c for c in CALL if c != "dest_service"]).join(parent, ["trace_id", "span_id"])
    return met.unionByName(found.select(*CALL))


def events_per_second(spans: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ST-13: the trailing ten seconds, every second."""
    return spans.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", late).groupBy(F.window("start_time", "10 seconds", "1 second")).agg((F.count(F.lit(1)) / 10).alias("eps")).select(F.col("window.end").alias("at"), "eps")


def adaptive(spans: DataFrame, target_eps: float, r: Rates = Rates(), seconds: int = 10, late: str = "10 seconds") -> DataFrame:
    """SMP-05: each span with the load of the trailing seconds at its own, the rate that follows, and whether it is kept,
    once the watermark has passed that second: a sliding count, joined back to the spans that it governs,
    which wait in the join's state no longer than the watermark."""
    timed = watermarked(spans, late)
    second = F.expr("start_ns div 1000000000")
    load = timed.groupBy(F.window("__at", f"{seconds} seconds", "1 second")).agg((F.count(F.lit(1)) / seconds).alias("eps"))
    load = load.select(F.window_time("window").alias("load_at"), (F.unix_seconds("window.end") - 1).alias("load_second"), "eps")
    near = F.expr("__at > load_at - INTERVAL 1 second AND __at <= load_at")
    met = timed.withColumn("second", second).join(load, (F.col("second") == F.col("load_second")) & near)
    return rated(met.drop("__at", "second", "load_at", "load_second"), target_eps, r)


def span_sink(spans: DataFrame, path: str, checkpoint: str, seconds: int = 5, once: bool = False, quarantine: str | None = None, retries: int = 3, counters: Counters | None = None) -> StreamingQuery:
    """SNK-01 to SNK-03: micro-batches of spans to Parquet, tried again a few times when a write fails. Each
    batch has folders of its own, which a repeated batch overwrites, so nothing is there twice; sources.upkeep
    merges the folders."""

    def write(df, batch):
        again = with_retries(lambda: write_spans(df, path, quarantine, batch=batch), retries)
        if counters is not None:
            counters.retried += again

    writer = counted(spans).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def counted_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """SRC-14: records with a note for Counters of how many there are and how many are too short to be decoded."""
    return records.observe("records", F.count(F.lit(1)).alias("total"), F.count_if(F.length(record_col) < RAW_SIZE).alias("dropped"))


def counted_events(events: DataFrame, kind: str = "kind") -> DataFrame:
    """SRC-14: events with a note of how many connections they open and close."""
    return events.observe("connections", F.count_if(F.col(kind) == "open").alias("opened"), F.count_if(F.col(kind) == "close").alias("closed"))


def counted(spans: DataFrame) -> DataFrame:
    """SNK-08: spans with a note of how many of them can be kept."""
    return spans.observe("spans", F.count(F.lit(1)).alias("total"), F.count_if(~is_good()).alias("dropped"))


def http_post(url: str, timeout_s: float = 1.0) -> Callable[[str], None]:
    """A function that posts a JSON body and raises where the answer isn't a success."""

    def post(body: str) -> None:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout_s):
            pass

    return post


def alert_sink(bodies: DataFrame, post: Callable[[str], None], checkpoint: str, once: bool = False, retries: int = 3, undelivered: str | None = None, counters: Counters | None = None) -> StreamingQuery:
    """SNK-07: every alert's JSON body is posted from the executors, with retries of its own. One that still
    fails is counted, kept under `undelivered` with the error, and holds up no other: a batch is repeated only where
    its task is lost. bodies may have further columns."""

    def posted(batches):
        for b in batches:
            failed = []
            for body in b.column("body").to_pylist():
                try:
                    with_retries(lambda body=body: post(body), retries)
                except Exception as e:
                    failed.append((body, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in failed], pa.string()) for i in (0, 1)], ["body", "error"])

    def send(batch, number):
        failed = batch.select("body").mapInArrow(posted, "body string, error string")
        if undelivered:
            failed.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(undelivered)
            n = batch.sparkSession.read.schema("body string, error string, batch long").parquet(undelivered).filter(F.col("batch") == number).count()
        else:
            n = failed.count()
        if counters is not None:
            counters.undelivered += n

    writer = bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Counters(StreamingQueryListener):
    """SRC-14, SNK-08: what all queries have read and written, what was dropped (too short to decode, or without ids or
    time), writes tried again, queries that failed, and open connections, from the notes of counted_records,
    counted_events and counted. The queue is what waits at a source: the rows that the last batch of each query
    found, against a capacity."""

    def __init__(self, queue_capacity: int = 100_000):
        self.read = self.written = self.batches = self.failed = self.dropped = self.retried = self.undelivered = self.connections = 0
        self.queue_capacity, self.waiting = queue_capacity, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        rows = p.get("numInputRows", 0)
        self.read += rows
        self.waiting[p.get("id")] = rows
        notes = p.get("observedMetrics") or {}
        self.written += max(0, (p.get("sink") or {}).get("numOutputRows", 0) or 0)
        for name in ("records", "spans"):
            self.dropped += notes.get(name, {}).get("dropped") or 0
        if "spans" in notes:
            self.written += notes["spans"]["total"] - notes["spans"]["dropped"]
        if "connections" in notes:
            self.connections = max(0, self.connections + notes["connections"]["opened"] - notes["connections"]["closed"])
        self.batches += 1

    def onQueryIdle(self, event):
        self.waiting[str(event.id)] = 0

    def onQueryTerminated(self, event):
        self.failed += event.exception is not None
        self.waiting.pop(str(event.id), None)

    def stats(self) -> dict:
        return {"total": self.read, "flushed": self.written, "batches": self.batches, "failed": self.failed, "retried": self.retried, "dropped": self.dropped, "undelivered": self.undelivered, "queue_size": sum(self.waiting.values()), "queue_capacity": self.queue_capacity, "connections": self.connections}
