"""The engine's query surface: what the REST routes answer, as Python calls and over HTTP."""

from __future__ import annotations

import argparse
import json
import logging
import re
import signal
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, flame, sampling, search, similarity, stats, trees
from .operators.search import STATS_BACK, TraceQuery


LOG = logging.getLogger(__name__)
# The headers that browsers of other hosts ask for.
CORS = (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, PUT, DELETE, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type, Authorization"))


class NotFound(Exception):
    """Nothing has that id."""


class TimedOut(Exception):
    """The time limit of a request has passed."""


# Seconds that a request may take, by the first part of its route that is listed, and a shutdown.
LIMITS_S = {"/services/": 15, "/services": 10, "/service-map": 15, "/health": 5, "": 30}
SHUTDOWN_S = 10
#: Frames that a picture has at most.
FRAMES = 50_000
#: Spans of one trace start so close together, unless an engine is told otherwise.
LONGEST_US = 86_400_000_000


def limited(spark: SparkSession, seconds: float, call: Callable):
    """call()'s result. After so many seconds its Spark jobs are cancelled, again and again until it ends,
    and TimedOut is raised."""
    tag, late, done = f"request-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.1):
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return call()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"more than {seconds:g} seconds") from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def envelope(data, code: int = 200, message: str = "success") -> dict:
    """SNK-09, S-22."""
    return {"code": code, "message": message, "data": data}


def millis(value, default: int = 0) -> int:
    """FLT-10: a number of milliseconds, 0 where it can't be read."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


class Engine:
    """Queries over a DataFrame of spans. Pages and single traces are collected, and statistics by operation, edge
    or key, whose rows are bounded by how many different ones there are."""

    def __init__(self, spans: DataFrame, rates: sampling.Rates = sampling.Rates(), detector: anomaly.Detector = anomaly.Detector(), counters=None, longest_us: int | None = LONGEST_US, limits_s: dict[str, float] = LIMITS_S, rollup: DataFrame | None = None):
        """rollup: minutes of service statistics, which then say what services there are instead of all spans."""
        self.rollup = rollup
        self.spans, self.rates, self.detector, self.counters, self.since = spans, rates, detector, counters, time.time()
        self.longest_us, self.limits_s, self.counted = longest_us, limits_s, (0.0, 0)

    def within_limit(self, route: str, call: Callable):
        seconds = next(s for start, s in self.limits_s.items() if route.startswith(start))
        return limited(self.spans.sparkSession, seconds, call) if self.spans is not None else call()

    def trace(self, trace_id: str, start_ms=None, end_ms=None) -> dict:
        """TR-01, TR-03: a trace with its tree; with a time range only its months are read."""
        spans = self._within(start_ms, end_ms) if start_ms or end_ms else self.spans
        rows = [r.asDict() for r in search.trace(spans, trace_id).collect()] if trace_id else []
        if not rows:
            raise NotFound(f"no trace {trace_id!r}")
        return assembled(rows)

    def search(self, q: TraceQuery, now: datetime | None = None) -> dict:
        """TR-02; total is the size of the page."""
        by_id: dict[str, list[dict]] = {}
        for r in search.search(self.spans, q.with_defaults(now)).collect():
            by_id.setdefault(r["trace_id"], []).append(r.asDict())
        found = sorted((assembled(rows) for rows in by_id.values()), key=lambda t: max(s["start_ns"] for s in t["spans"]), reverse=True)
        return {"traces": found, "total": len(found), "limit": q.limit or search.PAGE, "offset": q.offset}

    def services(self, start_ms=None, end_ms=None) -> list[str]:
        """AGG-07: of a time range, where one is asked for (of whole minutes, where there is a rollup)."""
        return [r.service_name for r in search.services(self._served(start_ms, end_ms)).collect()]

    def _served(self, start_ms=None, end_ms=None) -> DataFrame:
        """Rows of the services of a time range: of the rollup if there is one, else spans."""
        if self.rollup is None:
            return self._within(start_ms, end_ms)
        start, end = millis(start_ms) * 1000, millis(end_ms) * 1000
        found = self.rollup.filter(F.col("minute_us") >= start - start % stats.MINUTE_US) if start else self.rollup
        return found.filter(F.col("minute_us") <= end) if end else found

    def _range(self, start_ms, end_ms) -> tuple[int, int]:
        now = datetime.now(timezone.utc)
        ms = lambda t: int(t.timestamp() * 1000)
        return (millis(start_ms) or ms(now - STATS_BACK)) * 1000, (millis(end_ms) or ms(now)) * 1000

    def service_stats(self, service: str, start_ms=None, end_ms=None, exact: bool = False) -> list[dict]:
        """AGG-01. Quantiles come from sketches of bounded size, unless exact ones are asked for."""
        return [r.asDict() for r in stats.service_stats(self.spans, service, *self._range(start_ms, end_ms), exact=exact).collect()]

    def service_map(self, start_ms=None, end_ms=None) -> list[dict]:
        return [r.asDict() for r in stats.service_map(self.spans, *self._range(start_ms, end_ms), longest_us=self.longest_us).collect()]

    def _within(self, start_ms, end_ms) -> DataFrame:
        """All spans, or those of a time range where one is asked for."""
        return search.matching(self.spans, TraceQuery(start_us=millis(start_ms) * 1000 or None, end_us=millis(end_ms) * 1000 or None)).drop("month")

    def sampling_stats(self, start_ms=None, end_ms=None) -> dict:
        return sampling.counters(sampling.sampled(self._within(start_ms, end_ms), self.rates)).collect()[0].asDict()

    def anomaly_stats(self, start_ms=None, end_ms=None) -> list[dict]:
        return [r.asDict() for r in anomaly.listing(anomaly.fold(self._within(start_ms, end_ms), self.detector)).collect()]

    def compression_stats(self, limit: int = 100, offset: int = 0, start_ms=None, end_ms=None, structures: bool = False) -> dict:
        """CMP-09, AGG-17: totals over all subtrees, and a page of the signatures that repeat, with the ids of
        a subtree that has each, and with its text where structures are asked for."""
        spans = self._within(start_ms, end_ms)
        all_ = similarity.occurrences(similarity.signatures(trees.trees(spans, hashes=True))).cache()
        repeated = all_.filter("count > 1").orderBy(F.desc("count"), "hash").offset(max(0, offset)).limit(limit if limit > 0 else 100)
        counted = all_.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("cache_hits"), F.count(F.lit(1)).alias("cache_misses"), F.count_if(F.col("count") > 1).alias("duplicate_subtrees")).first().asDict()
        page = similarity.spelt(spans, repeated).orderBy(F.desc("count"), "hash") if structures else repeated
        found = {"totals": similarity.totals(similarity.compress(spans)).collect()[0].asDict(), **counted, "signatures": [r.asDict(True) for r in page.collect()]}
        all_.unpersist()
        return found

    def flamegraph(self, trace_id: str, form: str = "svg", width: int = flame.WIDTH):
        """FG-01 to FG-06 for one trace. A picture is of the frames that can be seen, of at most FRAMES of them from
        the root down; it says how many are left out."""
        tree = trees.trees(search.trace(self.spans, trace_id), paths=form == "folded")
        if form == "folded":
            return "\n".join(r.line for r in flame.folded(tree).orderBy("visit").collect())
        if form == "stats":
            return {"stats": [r.asDict() for r in flame.frame_stats(tree).collect()], "hot_spots": [r.asDict() for r in flame.hot_spots(tree, 10).collect()]}
        rows = [r.asDict() for r in flame.picture(search.trace(self.spans, trace_id), width).orderBy("depth", "x", "span_id").limit(FRAMES).collect()]
        if not rows:
            raise NotFound(f"no trace {trace_id!r}")
        return flame.svg(rows, f"Trace {trace_id}", width)

    def health(self, fresh_s: float = 60) -> dict:
        """AGG-10. Probes come often, so the services are counted once a minute at most."""
        at, services = self.counted
        if time.time() - at > fresh_s:
            services = search.service_count(self._served()).collect()[0].services
            self.counted = (time.time(), services)
        return {"status": "healthy", "services": services, "uptime_seconds": time.time() - self.since}

    def system_stats(self) -> dict:
        """AGG-14, SNK-08: counters, what was lost in percent, alerts and warnings."""
        c = {"total": 0, "dropped": 0, "failed": 0, "queue_size": 0, "queue_capacity": 0, "connections": 0} | (self.counters.stats() if self.counters else {})
        percent = lambda a, b: c[a] / c[b] * 100 if c[b] else 0.0
        raised = stats.alerts({"events_dropped": c["dropped"], "failed_batches": c["failed"], **c})
        told = {"event_alert": f"events dropped: {c['dropped']}", "queue_alert": f"queue almost full: {c['queue_size']} of {c['queue_capacity']}", "batch_alert": f"failed batches: {c['failed']}", "connection_warning": f"open connections: {c['connections']}"}
        said = lambda kind: [text for name, text in told.items() if name.endswith(kind) and raised[name]]
        return {**c, "drop_rate": percent("dropped", "total"), "queue_usage_percent": percent("queue_size", "queue_capacity"), "alerts": said("alert"), "warnings": said("warning"), "timestamp": int(time.time())}

    def metrics(self) -> str:
        return "".join(f"tracespark_{k} {v}\n" for k, v in self.system_stats().items() if isinstance(v, (int, float)))


#: Levels of a tree that are given as nested objects; JSON readers and writers take hardly more.
NESTED = 200


def assembled(rows: list[dict]) -> dict:
    """Spans of one trace, in order, as an envelope with a nested tree. Of a tree of over NESTED levels the root has no
    children; parents, the place of each span's parent among the spans, says where they belong."""
    root, children = trees.root_and_children(rows)
    parents: list[int | None] = [None] * len(rows)
    for i, kids in enumerate(children):
        for c in kids:
            parents[c] = i
    walked, depth = ([root], {root: 1}) if root is not None else ([], {})
    for i in walked:
        for c in children[i]:
            depth[c] = depth[i] + 1
            walked.append(c)
    tree = rows[root] if root is not None else None
    deep = max(depth.values(), default=0) > NESTED
    if tree is not None and not deep:
        made: dict[int, dict] = {}
        for i in reversed(walked):
            made[i] = {**rows[i], "children": [made[c] for c in children[i]]}
        tree = made[root]
    start, end = min(r["start_ns"] for r in rows), max(r["end_ns"] for r in rows)
    return {"trace_id": rows[0]["trace_id"], "spans": rows, "root": tree, "start_ns": start, "end_ns": end, "duration_ms": (end - start) / 1e6, **({"parents": parents} if deep else {})}


def answer(engine: Engine, target: str) -> tuple[int, str, str]:
    """Status, content type and body for a request target."""
    url = urlparse(target)
    q = {k: v[-1] for k, v in parse_qs(url.query).items()}
    number = lambda k: float(q[k]) if re.fullmatch(r"\d+(\.\d+)?", q.get(k, "")) else None

    def searched():
        return engine.search(TraceQuery(q.get("service"), millis(q.get("start")) * 1000 or None, millis(q.get("end")) * 1000 or None, number("min_duration"), number("max_duration"), q.get("protocol"), q.get("trace_id"), millis(q.get("limit")), millis(q.get("offset"))))

    routes = {
        r"/trace/([^/]+)": lambda i: engine.trace(i, q.get("start"), q.get("end")),
        r"/trace/([^/]+)/flamegraph": lambda i: engine.flamegraph(i, q.get("format", "svg"), millis(q.get("width")) or flame.WIDTH),
        r"/traces": searched,
        r"/services": lambda: engine.services(q.get("start"), q.get("end")),
        r"/services/([^/]+)/stats": lambda s: engine.service_stats(s, q.get("start"), q.get("end"), q.get("exact") == "true"),
        r"/service-map": lambda: engine.service_map(q.get("start"), q.get("end")),
        r"/sampling/stats": lambda: engine.sampling_stats(q.get("start"), q.get("end")),
        r"/anomaly/stats": lambda: engine.anomaly_stats(q.get("start"), q.get("end")),
        r"/compression/stats": lambda: engine.compression_stats(millis(q.get("limit")), millis(q.get("offset")), q.get("start"), q.get("end"), q.get("structures") == "true"),
        r"/health": lambda: engine.health(),
        r"/system/stats": lambda: engine.system_stats(),
    }
    if url.path == "/metrics":
        return 200, "text/plain", engine.metrics()
    for pattern, call in routes.items():
        if m := re.fullmatch("/api/v1" + pattern, url.path):
            try:
                data = engine.within_limit(url.path.removeprefix("/api/v1"), lambda call=call, m=m: call(*map(unquote, m.groups())))
            except NotFound as e:
                return 404, "application/json", json.dumps(envelope(None, 404, str(e)))
            except TimedOut as e:
                return 504, "application/json", json.dumps(envelope(None, 504, str(e)))
            if isinstance(data, str):
                return 200, "image/svg+xml" if data.startswith("<svg") else "text/plain", data
            return 200, "application/json", json.dumps(envelope(data), default=str)
    return 404, "application/json", json.dumps(envelope(None, 404, "not found"))


def serve(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    """An HTTP server for the routes; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            for name, value in (("Content-Type", kind), ("Content-Length", str(len(data))), *CORS):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self):
            self.reply(204, "text/plain", "")

        def do_GET(self):
            began = time.perf_counter()
            try:
                found = answer(engine, self.path)
            except Exception:
                LOG.exception("%s", self.path)
                found = 500, "application/json", json.dumps(envelope(None, 500, "internal error"))
            self.reply(*found)
            LOG.info("GET %s %s %d %.3f s", self.path, self.client_address[0], found[0], time.perf_counter() - began)

        def log_message(self, form, *args):
            pass

    class Server(ThreadingHTTPServer):
        daemon_threads = False  # server_close() waits for running requests

    return Server(("", port), Handler)


def stop(server: ThreadingHTTPServer, spark: SparkSession | None = None, seconds: float = SHUTDOWN_S) -> None:
    """Takes no more requests, lets the running ones end within so many seconds, cancels the jobs of those that
    don't, and stops the session's streams."""
    server.shutdown()
    closed = threading.Thread(target=server.server_close, daemon=True)
    closed.start()
    closed.join(seconds)
    if spark is not None:
        for query in spark.streams.active:
            query.stop()
        if closed.is_alive():
            spark.sparkContext.cancelAllJobs()
            closed.join(seconds)


def main() -> None:
    """python -m tracespark.api --spans FOLDER [--rollup FOLDER] [--port N] [--config FILE]; ends in order on SIGINT and SIGTERM"""
    from .sources import tables

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--spans", required=True)
    parser.add_argument("--rollup", help="minutes of service statistics, as Parquet")
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--config")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("tracespark").getOrCreate()
    config = tables.load_config(given.config)
    server = serve(Engine(tables.read_spans(spark, given.spans), config.rates(), config.detector(), rollup=spark.read.parquet(given.rollup) if given.rollup else None), given.port)
    ending = threading.Event()
    for name in (signal.SIGINT, signal.SIGTERM):
        signal.signal(name, lambda *_: ending.set())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ending.wait()
    stop(server, spark)
    spark.stop()


if __name__ == "__main__":
    main()
