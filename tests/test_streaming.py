import json

import pytest
from pyspark.sql import functions as F

from tracespark import api
from tracespark.operators import anomaly, correlate, sampling, stats
from tracespark.plans import views
from tracespark.sources import tables
from tracespark.streaming import pipelines as S


@pytest.fixture
def stream(spark, tmp_path):
    """A DataFrame as a stream of one file, and a function that runs a stream to its end."""
    S.state_store(spark)

    def of(df, name="in"):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    return of, run


def test_correlation_equals_replay(spark, sf, stream):
    of, run = stream
    events = views.connections(spark, sf)
    key = lambda df: {(r.parent_span_id, r.span_id, r.duration_ms) for r in df.filter("parent_span_id IS NOT NULL").collect()}
    got = run(S.correlated(of(events), timeout_s=10**8), "correlated")
    assert key(got) == key(correlate.replay(events, timeout_s=10**8)) and key(got)


def in_two_runs(spark, tmp_path, parts, made, name):
    """A stream that ends after the first file and is started again, from its checkpoint, for the second."""
    S.state_store(spark)
    found = []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        writer = made(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
        writer.start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_correlation_goes_on_after_a_restart(spark, sf, tmp_path):
    """Requests of the first run are answered, evicted and closed in the second as if there had been one."""
    from test_queues import traffic

    rows = sorted(((c, k, at + 10**18, *rest) for c, k, at, *rest in traffic(4, ["hot", "a", "b"], 1200)), key=lambda r: (r[2], r[3]))
    half = rows[600][2]
    frame = lambda keep: spark.createDataFrame([r for r in rows if keep(r)], correlate.EVENT)
    parts = [frame(lambda r: r[2] < half), frame(lambda r: r[2] >= half)]
    got = in_two_runs(spark, tmp_path, parts, lambda e: S.correlated(e, most=4, timeout_s=10**6), "restarted")
    want = correlate.replay(frame(lambda r: True), 4, 10**6).filter("tag IS NULL OR tag <> 'in_flight'")
    plain = lambda df: sorted(tuple(r) for r in df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in want.columns]).collect())
    assert plain(got) == plain(want) and {r.tag for r in got.collect()} == {None, "evicted", "connection_closed", "orphan_response"}


def test_silent_connections_are_given_up_by_a_timer(spark, tmp_path):
    """The second file moves the watermark past the first one's requests."""
    s = 10**9
    first = spark.createDataFrame([("a", "request", s, 1, "s1", "t"), ("a", "request", 2 * s, 2, "s2", "t"), ("b", "request", 2 * s, 3, "s3", "t"), ("b", "response", 3 * s, 4, "s4", "t")], correlate.EVENT)
    later = spark.createDataFrame([("c", "request", 500 * s, 5, "s5", "t")], correlate.EVENT)
    got = in_two_runs(spark, tmp_path, [first, later], lambda e: S.correlated(e, timeout_s=30, late="1 second"), "silent")
    assert {(r.span_id, r.tag) for r in got.collect()} == {("s3", None), ("s4", None), ("s1", "connection_timeout"), ("s2", "connection_timeout")}


def test_anomalies_go_on_after_a_restart(spark, sf, tmp_path):
    """Averages, cooldowns and idle gaps are carried over."""
    d = anomaly.Detector(0.05, 3.0, least=5, idle_s=40, cooldown_s=20)
    rows = [(f"t{i}", f"s{i:04}", "svc", "op", "HTTP", (1000 + i + 60 * (i >= 300)) * 10**9, 10.0 + (500.0 if i % 37 == 36 or i % 37 == 35 else i % 3)) for i in range(400)]
    spans = spark.createDataFrame(rows, anomaly.SAMPLE)
    parts = [spans.filter("start_ns < 1200000000000"), spans.filter("start_ns >= 1200000000000")]
    got = in_two_runs(spark, tmp_path, parts, lambda e: S.anomalies(e, d, late="1 hour"), "resumed")
    folded = anomaly.fold(spans, d)
    columns = ["span_id", "n", F.round("ewma", 6), "is_anomaly", "severity"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, folded.select(*columns).collect()))
    told = lambda df: {r.span_id for r in df.filter("is_sent").collect()}
    assert told(got) == told(anomaly.sent(folded, d)) and told(got)


def test_sampling_decides_for_whole_traces(spark, sf, stream):
    of, run = stream
    spans = views.spans(spark, sf).filter("trace_id < lpad('200', 32, '0')")
    rates = sampling.Rates(200, 1.0, 0.25)
    got = run(S.sampled(of(spans), rates), "sampled_spans")
    ids = lambda df: {(r.trace_id, r.span_id) for r in df.select("trace_id", "span_id").collect()}
    assert ids(got) == ids(sampling.sampled_traces(spans, rates)) and got.columns == spans.columns


def test_anomalies_equal_the_batch_fold(spark, sf, stream):
    of, run = stream
    d = anomaly.Detector(0.05, 3.0, idle_s=10**9)
    spans = views.latencies(spark, sf)
    got = run(S.anomalies(of(spans), d), "folded")
    columns = ["span_id", "n", F.round("ewma", 6), "is_anomaly", "severity"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, anomaly.fold(spans, d).select(*columns).collect()))


def test_rollups_hold_back_open_minutes(spark, sf, stream):
    of, run = stream
    spans = views.latencies(spark, sf)
    got = run(S.stats_rollup(of(spans)), "minutes")
    batch = {(r.minute_us, r.operation): r.call_count for r in stats.stats_rollup(spans).collect()}
    seen = {(r.minute_us, r.operation): r.call_count for r in got.collect()}
    assert seen.items() <= batch.items() and len(batch) - len(seen) < 10
    longer = stats.merged_stats(got).filter("call_count > 2").select("period_us", "p50_duration_ms", "min_duration_ms", "max_duration_ms").collect()
    assert longer and all(r.min_duration_ms <= r.p50_duration_ms <= r.max_duration_ms for r in longer)


def test_map_rollup_and_rate(spark, sf, stream):
    of, run = stream
    spans = views.spans(spark, sf).withColumn("start_time", F.timestamp_micros(F.expr("(start_ns div 1000) % 3600000000"))).filter("trace_id < lpad('300', 32, '0')")
    got = run(S.map_rollup(of(spans)), "edges")
    assert set(got.columns) >= {"minute_us", "source_service", "dest_service", "call_count", "avg_duration_ms", "p95_duration_ms", "p99_duration_ms"}
    rate = run(S.events_per_second(of(views.latencies(spark, sf), "in2")), "rate")
    assert rate.count() > 0


def test_sinks_and_counters(spark, sf, stream, tmp_path):
    of, _ = stream
    listener = S.Counters()
    spark.streams.addListener(listener)
    spans = views.latencies(spark, sf).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.SPAN if f.name not in views.latencies(spark, sf).columns])
    query = S.span_sink(of(spans), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    query.awaitTermination()
    assert tables.read_spans(spark, str(tmp_path / "out")).count() == spans.count()
    again = S.span_sink(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    again.awaitTermination()
    assert tables.read_spans(spark, str(tmp_path / "out")).count() == spans.count()
    spark.streams.removeListener(listener)
    tables.write_spans(spans, str(tmp_path / "out"), batch=0)  # as when the same batch is tried again
    bad = spans.limit(3).withColumn("trace_id", F.lit(""))
    for _ in range(2):
        tables.write_spans(bad, str(tmp_path / "out"), str(tmp_path / "bad"), batch=9)
    assert tables.read_spans(spark, str(tmp_path / "out")).count() == spans.count() and spark.read.parquet(str(tmp_path / "bad")).count() == 3
    assert listener.stats()["dropped"] == 0
    posted = tmp_path / "posted"
    posted.mkdir()
    bodies = anomaly.alert_body(anomaly.alerts(anomaly.fold(views.latencies(spark, sf), anomaly.Detector(0.05, 3.0, least=10, idle_s=10**9))))
    n = bodies.count()

    def post(body, folder=str(posted)):
        alert = json.loads(body)[0]
        with open(f"{folder}/{alert['labels']['span_id']}", "w") as f:
            f.write(alert["annotations"]["threshold"])

    S.alert_sink(of(bodies, "bodies"), post, str(tmp_path / "check2"), once=True).awaitTermination()
    assert n > 0 and len(list(posted.iterdir())) == n


def test_an_alert_that_fails_holds_up_no_other(spark, stream, tmp_path):
    of, _ = stream
    counters, posted = S.Counters(), tmp_path / "posted"
    posted.mkdir()

    def post(body, folder=str(posted)):
        with open(f"{folder}/{body}", "a") as f:
            f.write("x")
        if body == "bad":
            raise OSError("no")

    bodies = spark.createDataFrame([(b,) for b in ("a", "bad", "c")], "body string")
    S.alert_sink(of(bodies), post, str(tmp_path / "check"), once=True, retries=1, undelivered=str(tmp_path / "lost"), counters=counters).awaitTermination()
    assert {p.name: p.read_text() for p in posted.iterdir()} == {"a": "x", "bad": "xx", "c": "x"}
    assert counters.stats()["undelivered"] == 1 and spark.read.parquet(str(tmp_path / "lost")).first().error == "OSError: no"


def test_counters_tell_what_was_dropped(spark, sf, stream, tmp_path):
    """Short records, spans without ids, open connections, writes tried again: each of them is counted, and alerts come of it."""
    of, run = stream
    counters = S.Counters(queue_capacity=100)
    spark.streams.addListener(counters)
    try:
        records = spark.createDataFrame([(b"x" * 10,)] * 101 + [(b"x" * 1424,)] * 4, "record binary")
        run(S.counted_records(of(records, "records")), "counted_records")
        events = spark.createDataFrame([("open",)] * 5 + [("close",)] * 2, "kind string")
        run(S.counted_events(of(events, "events")), "counted_events")
        good = views.latencies(spark, sf).limit(50).withColumns({"payload": F.lit("x"), "end_time": F.col("start_time")})
        spans = good.unionByName(good.limit(3).withColumn("span_id", F.lit("")))
        S.span_sink(of(spans, "spans"), str(tmp_path / "out"), str(tmp_path / "check"), once=True, counters=counters).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counters)
    found = counters.stats()
    assert found["dropped"] == 104 and found["connections"] == 3 and found["flushed"] >= 50 and found["retried"] == 0
    told = api.Engine(None, counters=counters).system_stats()
    assert told["alerts"][0] == "events dropped: 104"


def test_adaptive_sampling_decides_as_the_batch_does(spark, tmp_path):
    """Two bursts and a quiet time in two runs; a later span moves the watermark past them."""
    base = 1_700_000_000 * 10**9
    at = [base + i * 5_000_000 for i in range(1500)] + [base + 60 * 10**9 + i * 700_000_000 for i in range(40)] + [base + 120 * 10**9 + i * 2_000_000 for i in range(1000)]
    rows = [(f"s{i:05}", t, 700.0 if i % 50 == 0 else 10.0, 500 if i % 70 == 0 else 0) for i, t in enumerate(at)]
    spans = spark.createDataFrame(rows, "span_id string, start_ns long, duration_ms double, error_code int")
    last = spark.createDataFrame([("end", base + 500 * 10**9, 1.0, 0)], spans.schema)
    cut = base + 100 * 10**9
    r = sampling.Rates(500, 1.0, 0.5)
    got = in_two_runs(spark, tmp_path, [spans.filter(F.col("start_ns") < cut), spans.filter(F.col("start_ns") >= cut), last], lambda s: S.adaptive(s, 5.0, r), "adaptive")
    plain = lambda df: sorted((x.span_id, round(x.eps, 6), round(x.rate, 9), x.kept) for x in df.collect())
    assert plain(got) == plain(sampling.adaptive(spans, 5.0, r)) and {x.kept for x in got.collect()} == {True, False}


def test_calls_of_a_stream_and_their_completion_equal_the_batch(spark, tmp_path):
    """Some parents start half an hour after or before their children; some spans have none."""
    S.state_store(spark)
    base, rows = 1_700_000_000, []
    for i in range(120):
        apart = 1800 * (i % 4 == 3) * (1 if i % 8 == 3 else -1)
        rows += [(f"t{i}", "p", "", f"svc-{i % 3}", "HTTP", base + 20 * i + apart, 5.0, 0), (f"t{i}", "c", "p" if i % 10 else "gone", f"svc-{i % 2}", "HTTP", base + 20 * i + 1, 3.0 + i, 500 * (i % 7 == 0))]
    rows.sort(key=lambda r: r[5])
    frame = lambda rows: spark.createDataFrame([(*r[:5], r[5] * 10**9, r[6], r[7]) for r in rows], "trace_id string, span_id string, parent_span_id string, service_name string, protocol string, start_ns long, duration_ms double, error_code int").withColumn("start_time", F.timestamp_seconds(F.expr("start_ns div 1000000000")))
    spans = frame(rows)
    for part in (frame(rows[:100]), frame(rows[100:]), frame([("end", "e", "", "s", "HTTP", base + 10**6, 1.0, 0)])):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.call_sink(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    plain = lambda df: sorted(map(str, df.select("minute_us", "source_service", "dest_service", "protocol", "call_count", "error_count", "sum_duration_ms", "p95_duration_ms").collect()))
    assert stored.filter("is_met = 'false'").count() > 20
    assert plain(stats.rollup_of_calls(S.completed_calls(stored, spans))) == plain(stats.map_rollup(spans))
