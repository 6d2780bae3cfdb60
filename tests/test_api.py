import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tracespark import api
from tracespark.operators import stats as rollups
from tracespark.operators.search import TraceQuery
from tracespark.plans import views


@pytest.fixture(scope="module")
def engine(spark, sf):
    return api.Engine(views.spans(spark, sf).filter("trace_id < lpad('60', 32, '0')").cache())


ONE = "1".rjust(32, "0")
ALL = "start=1&end=2000000000000"


def get(engine, target):
    status, kind, body = api.answer(engine, target)
    return status, json.loads(body) if kind == "application/json" else body


def test_trace_and_search(engine):
    status, body = get(engine, f"/api/v1/trace/{ONE}")
    assert status == 200 and body["data"]["trace_id"] == ONE and body["data"]["root"]["service_name"] == "gateway"
    assert len(body["data"]["spans"]) == 1 + count(body["data"]["root"]) - 1
    assert get(engine, "/api/v1/trace/none")[0] == 404
    _, body = get(engine, f"/api/v1/traces?service=svc-A&{ALL}&limit=3&min_duration=0")
    assert body["data"]["total"] == 3 and all(any(s["service_name"] == "svc-A" for s in t["spans"]) for t in body["data"]["traces"])
    assert engine.search(TraceQuery())["total"] == 0  # nothing in the last day


def count(node):
    return 1 + sum(map(count, node["children"]))


def test_statistics(engine):
    assert get(engine, "/api/v1/services")[1]["data"] == ["gateway", "svc-A", "svc-N", "svc-R"]
    stats = get(engine, f"/api/v1/services/svc-R/stats?{ALL}")[1]["data"]
    assert stats and stats[0]["call_count"] >= stats[-1]["call_count"]
    assert {e["caller"] for e in get(engine, f"/api/v1/service-map?{ALL}")[1]["data"]} <= {"gateway", "svc-A", "svc-N", "svc-R"}
    sampling = get(engine, "/api/v1/sampling/stats")[1]["data"]
    assert sampling["total"] == sampling["sampled"] + sampling["dropped"]
    assert get(engine, "/api/v1/anomaly/stats")[1]["data"][0]["n"] > 0
    packed = get(engine, "/api/v1/compression/stats")[1]["data"]
    assert packed["totals"]["total_spans"] == sampling["total"] and all(s["count"] > 1 for s in packed["signatures"])
    assert packed["duplicate_subtrees"] >= len(packed["signatures"]) and packed["cache_hits"] >= packed["duplicate_subtrees"]
    page = get(engine, "/api/v1/compression/stats?limit=1&offset=1")[1]["data"]["signatures"]
    assert page == packed["signatures"][1:2]
    texts = get(engine, "/api/v1/compression/stats?limit=3&structures=true")[1]["data"]["signatures"]
    assert [{k: v for k, v in t.items() if k != "structure"} for t in texts] == packed["signatures"][:3] and all(t["structure"].endswith("\n") for t in texts)
    assert get(engine, "/api/v1/health")[1]["data"]["services"] == 4
    assert get(engine, "/api/v1/system/stats")[0] == 200 and get(engine, "/metrics")[0] == 200
    assert get(engine, "/api/v1/nothing")[0] == 404 and api.millis("x") == 0


def test_flame_graphs(engine):
    assert get(engine, f"/api/v1/trace/{ONE}/flamegraph")[1].startswith("<svg")
    lines = get(engine, f"/api/v1/trace/{ONE}/flamegraph?format=folded")[1].split("\n")
    assert lines[0].startswith("gateway:") and all(line.startswith(lines[0].rpartition(" ")[0]) for line in lines)
    data = get(engine, f"/api/v1/trace/{ONE}/flamegraph?format=stats")[1]["data"]
    assert len(data["hot_spots"]) <= 10 and sum(s["calls"] for s in data["stats"]) == len(lines)
    assert get(engine, "/api/v1/trace/none/flamegraph")[0] == 404


def test_over_http(engine):
    server = api.serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/v1/services") as r:
        assert json.load(r)["code"] == 200 and r.headers["Access-Control-Allow-Origin"] == "*"
    ask = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/api/v1/services", method="OPTIONS")
    with urllib.request.urlopen(ask) as r:
        assert r.status == 204 and "OPTIONS" in r.headers["Access-Control-Allow-Methods"]
    broken = api.serve(None, 0)
    threading.Thread(target=broken.serve_forever, daemon=True).start()
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"http://127.0.0.1:{broken.server_address[1]}/api/v1/services")
    assert e.value.code == 500 and json.load(e.value)["code"] == 500
    broken.shutdown()
    server.shutdown()


def test_system_statistics_alert():
    class Counters:
        def stats(self):
            return {"total": 1000, "dropped": 125, "failed": 11, "queue_size": 81, "queue_capacity": 100, "connections": 500_001}

    found = api.Engine(None, counters=Counters()).system_stats()
    assert found["drop_rate"] == 12.5 and found["queue_usage_percent"] == 81 and len(found["alerts"]) == 3 and len(found["warnings"]) == 1
    assert api.Engine(None).system_stats()["alerts"] == []


def test_time_limits(engine, spark):
    """A request that takes too long has its jobs cancelled and is told so; the next one is answered."""
    import time

    slow = api.Engine(engine.spans, limits_s={"/services": 0.5, "": 60})
    nap = F.udf(lambda x: time.sleep(0.2) or x, "string")
    slow.spans = engine.spans.limit(2000).repartition(2).withColumn("service_name", nap("service_name"))
    began = time.time()
    status, body = get(slow, "/api/v1/services")
    assert status == 504 and body["code"] == 504 and time.time() - began < 30
    assert get(engine, "/api/v1/services")[0] == 200


def test_months_of_parents_are_pruned(spark, engine, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(api.stats, "service_map", lambda spans, a, b, longest_us: seen.update(longest=longest_us) or spans.limit(0))
    assert get(engine, f"/api/v1/service-map?{ALL}")[0] == 200 and seen["longest"] == api.LONGEST_US


def test_a_range_for_one_trace_and_for_services(engine):
    assert get(engine, f"/api/v1/trace/{ONE}?{ALL}")[1]["data"] == get(engine, f"/api/v1/trace/{ONE}")[1]["data"]
    assert get(engine, f"/api/v1/trace/{ONE}?start=1&end=2")[0] == 404
    assert get(engine, "/api/v1/services?start=1&end=2")[1]["data"] == []


def test_orderly_end(engine):
    """Requests that run are answered before the server is gone."""
    import time

    class Slow:
        def within_limit(self, route, call):
            return call()

        def services(self, *_):
            time.sleep(1)
            return ["late"]

    server = api.serve(Slow(), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, got = f"http://127.0.0.1:{server.server_address[1]}/api/v1/services", []
    asking = threading.Thread(target=lambda: got.append(json.load(urllib.request.urlopen(url))))
    asking.start()
    time.sleep(0.3)
    api.stop(server)
    asking.join(10)
    assert got[0]["data"] == ["late"]
    with pytest.raises(OSError):
        urllib.request.urlopen(url, timeout=2)


def test_services_from_a_rollup(engine):
    rolled = api.Engine(engine.spans, rollup=rollups.stats_rollup(engine.spans).cache())
    assert rolled.services() == engine.services() and rolled.health()["services"] == 4
    assert api.Engine(None, rollup=rolled.rollup).services() == engine.services()  # spans aren't read
    first, last = engine.spans.agg(F.min("start_ns"), F.max("start_ns")).first()
    assert rolled.services(first // 10**6, last // 10**6) == engine.services(first // 10**6, last // 10**6)
    assert rolled.services(last // 10**6 + 60_000) == [] == rolled.services(1, first // 10**6 - 60_000)


def test_quantiles_are_bounded_unless_exact_ones_are_asked_for(engine):
    close, exact = (get(engine, f"/api/v1/services/svc-R/stats?{ALL}{more}")[1]["data"] for more in ("", "&exact=true"))
    pick = lambda rows: [(r["operation"], r["protocol"], r["call_count"]) for r in rows]
    assert pick(close) == pick(exact) and exact
    occurring = {r.duration_ms for r in engine.spans.select("duration_ms").distinct().collect()}
    assert all(r["p95_duration_ms"] in occurring for r in close)
