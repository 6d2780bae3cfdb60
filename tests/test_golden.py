"""Facts that any implementation must agree with, and behaviour that SQL can't state."""

import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracespark.functions import codec, scalars
from tracespark.operators import anomaly, correlate, flame, sampling, search, similarity, stats, trees
from tracespark.operators.search import TraceQuery
from tracespark.schema import RAW_LAYOUT, RAW_SIZE
from tracespark.sources import raw, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_addresses_ports_and_times(spark):
    assert value(spark, scalars.dotted(F.lit(0x0100007F))) == "127.0.0.1"
    assert value(spark, scalars.dotted(F.lit(0x0200007F))) == "127.0.0.2"
    assert value(spark, scalars.dotted(F.lit(0xFF00007F).cast("long"))) == "127.0.0.255"
    assert value(spark, scalars.swapped_port(F.lit(0x901F))) == 8080
    assert value(spark, scalars.swapped_port(F.lit(0x5000))) == 80
    assert value(spark, scalars.millis(F.lit(150_000_000))) == 150.0


def test_codes(spark):
    assert [value(spark, scalars.event_name(F.lit(i))) for i in range(6)] == ["connect", "accept", "send", "recv", "close", "unknown"]
    assert [value(spark, scalars.protocol_name(F.lit(i))) for i in range(5)] == ["http", "grpc", "redis", "unknown", "unknown"]


def test_fnv_vectors(spark):
    for text, want in (("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8"), ("ünï", None)):
        got = value(spark, scalars.fnv1a_64(F.lit(text)))
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & (2**64 - 1)
        assert got == f"{h:016x}" and (want is None or got == want)
        assert value(spark, scalars.fnv1a_32(F.lit(text))) == flame.fnv32(text)


def test_raw_layout_adds_up():
    at = 0
    for _, offset, size, _ in RAW_LAYOUT:
        assert offset in (at, 44)
        at = offset + size
    assert at == 1419 and RAW_SIZE == 1424


def record(spark, **given_):
    fields = dict(timestamp=1_700_000_000_000_000_000, pid=1234, tid=5678, uid=0, gid=0, comm="svc", event_type=2, protocol=0, saddr=0x0100007F, daddr=0x0200007F, sport=80, dport=0x901F, duration_ns=150_000_000, error_code=200, payload_size=0, payload="", trace_id="", span_id="", parent_span_id="", path="") | given_
    return spark.range(1).select(codec.encode(**{k: F.lit(v) for k, v in fields.items()}).alias("record"))


def test_record_becomes_a_span(spark):
    e = raw.events(record(spark, payload="GET /x HTTP/1.1\r\nx-trace-id: abc\r\n\r\n", payload_size=5000))
    r = raw.spans(e).first()
    assert (r.event_type, r.protocol, r.duration_ms, r.source_ip, r.dest_ip, r.dest_port, r.source_port) == ("send", "http", 150.0, "127.0.0.1", "127.0.0.2", 8080, 80)
    assert (r.operation, r.trace_id, r.error_code, r.path, r.pid) == ("GET /x", "abc", 200, "/x", 1234)
    assert r.end_ns - r.start_ns == 150_000_000 and r.parent_span_id is None and len(r.span_id) == 16


def test_short_records_and_negative_errors(spark):
    short = spark.createDataFrame([(bytearray(1417),), (bytearray(0),), (None,)], "record binary")
    assert codec.decode(short).count() == 0
    r = raw.events(record(spark, event_type=0, error_code=-111, protocol=3, sport=1, dport=0)).first()
    assert (r.error_code, r.failed_connect, r.protocol, r.event) == (-111, True, "unknown", "connect")
    redis = raw.events(record(spark, event_type=3, protocol=3, sport=0xEB18, dport=40000)).first()
    assert (redis.protocol, redis.source_port) == ("redis", 6379)


def spans(spark, rows):
    base = [(t, s, p, "svc", o, "http", float(d), int(b * 1e6), int((b + d) * 1e6), 0) for t, s, p, o, b, d in rows]
    return spark.createDataFrame(base, "trace_id string, span_id string, parent_span_id string, service_name string, operation string, protocol string, duration_ms double, start_ns long, end_ns long, error_code int").withColumn("start_time", F.timestamp_micros(F.expr("start_ns div 1000")))


TREE = [("t", "root", "", "GET /api", 0, 300), ("t", "child1", "root", "DB Query", 50, 100), ("t", "child2", "root", "RPC Call", 100, 150), ("t", "grandchild", "child2", "Redis GET", 120, 10)]


def test_four_span_tree(spark):
    df = spans(spark, TREE)
    assert search.envelopes(df).first().duration_ms == 300
    got = {r.span_id: r for r in trees.trees(df, structures=True).collect()}
    assert (got["root"].children, got["child2"].children, got["root"].height, got["grandchild"].depth) == (2, 1, 3, 3)
    assert [got[s].visit for s in ("root", "child1", "child2", "grandchild")] == [0, 1, 2, 3]
    assert got["root"].structure == "svc:GET /api[\n  svc:DB Query\n  svc:RPC Call[\n    svc:Redis GET\n  ]\n]\n"
    assert got["root"].operations == ["GET /api", "DB Query", "RPC Call", "Redis GET"]


def test_odd_trees(spark):
    rows = [("a", "r1", "", "x", 0, 1), ("a", "r2", "", "y", 5, 1), ("a", "c", "r1", "z", 6, 1), ("b", "o", "missing", "x", 0, 1), ("c", "p", "q", "x", 0, 1), ("c", "q", "p", "x", 1, 1), ("d", "s", None, "x", 0, 1), ("d", "s", "", "later", 1, 1)]
    got = {(r.trace_id, r.span_id, r.operation): r for r in trees.trees(spans(spark, rows)).collect()}
    assert got["a", "r2", "y"].is_root and not got["a", "r1", "x"].in_tree and not got["a", "c", "z"].in_tree
    assert got["b", "o", "x"].is_orphan and not got["c", "p", "x"].in_tree
    assert got["d", "s", "later"].is_root and not got["d", "s", "x"].in_tree
    assert trees.trees(spans(spark, rows).limit(0)).count() == 0


def test_deep_tree_is_not_recursive(spark):
    rows = [("t", f"s{i}", f"s{i - 1}" if i else "", "op", i, 1) for i in range(1500)]
    assert trees.depths(trees.trees(spans(spark, rows))).first().depth == 1500


def test_long_chain_is_linear(spark):
    n = 100_000
    chain = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"), F.lit("s").alias("service_name"), F.lit("o").alias("operation"), F.lit("").alias("protocol"), F.lit(1.0).alias("duration_ms"), F.col("id").alias("start_ns"))
    got = trees.trees(chain)
    assert got.agg(F.max("depth"), F.max("height"), F.sum((F.col("visit") == F.col("start_ns")).cast("int")), F.sum("child_ms")).first() == (n, n, n, n - 1)


def test_trees_equal_walks_one_by_one(spark):
    """Random forests with repeated ids, cycles and missing parents against a recursive walk."""
    rng = random.Random(8)
    rows = []
    for t in "abcdefgh":
        for i in range(rng.randint(1, 40)):
            rows.append((t, f"s{rng.randint(0, 30)}", rng.choice(["", None, "gone", *[f"s{k}" for k in range(31)]]) if i else "", rng.choice("xyz"), i, rng.randint(1, 9)))
    got = {}
    for r in trees.trees(spans(spark, rows), structures=True, paths=True).collect():
        got.setdefault(r.trace_id, []).append(r)
    for t in "abcdefgh":
        mine = sorted(got[t], key=lambda r: r.start_ns)
        root, children = trees.root_and_children([r.asDict() for r in mine])
        seen = []

        def walk(i, above):
            path = [*above, f"svc:{mine[i].operation} [http]"]
            at = len(seen)
            seen.append(i)
            below = [walk(c, path) for c in children[i]]
            name = f"svc:{mine[i].operation}"
            lines = [name + "[", *("  " + x for _, ls, _ in below for x in ls), "]"] if below else [name]
            ops, height = [mine[i].operation, *(o for _, _, os in below for o in os)], 1 + max((h for h, _, _ in below), default=0)
            r = mine[i]
            assert (r.visit, r.depth, r.height, r.frames, r.operations, r.structure) == (at, len(path), height, path, ops, "\n".join(lines) + "\n")
            assert r.in_tree and r.is_root == (i == root) and r.children == len(below) and r.child_ms == sum(mine[c].duration_ms for c in children[i])
            return height, lines, ops

        if root is not None:
            walk(root, [])
        assert {i for i, r in enumerate(mine) if r.in_tree} == set(seen)


def layout(rows, width=flame.WIDTH):
    """The picture of one trace frame by frame, in the order of a walk."""
    total, out, used, hidden = max(rows[0]["value_us"], 1) if rows else 1, {}, {}, None
    for r in rows:
        level = r["depth"]
        if hidden is not None and level > hidden:
            continue
        hidden = None
        x, wide = used.get(level, 0), total if level == 1 else r["value_us"]
        used[level], used[level + 1] = x + wide, x
        if 2 * width * wide < total or x >= total:
            hidden = level
        else:
            out[r["span_id"]] = (pytest.approx(x / total * width), 25 + (level - 1) * flame.ROW, pytest.approx(wide / total * width))
    return out


def test_flame_picture(spark):
    tree = trees.trees(spans(spark, TREE), paths=True)
    rows = [r.asDict() for r in flame.picture(spans(spark, TREE)).orderBy("depth", "x").collect()]
    placed = {r["span_id"]: r for r in rows}
    assert placed["root"]["width"] == 1200 and placed["child1"]["x"] == 0 and placed["child2"]["x"] == pytest.approx(400)
    assert placed["grandchild"]["x"] == pytest.approx(400) and placed["grandchild"]["y"] == 25 + 2 * flame.ROW
    assert {s: (r["x"], r["y"], r["width"]) for s, r in placed.items()} == layout([r.asDict() for r in flame.frames(tree).orderBy("visit").collect()])
    assert flame.colour("x", 501, 0) == "hsl(0, 90%, 70%)" and flame.colour("x", 201, 20) == "hsl(30, 80%, 40%)"
    picture = flame.svg(rows, "a < b")
    assert picture.startswith("<svg") and picture.endswith("</svg>") and "a &lt; b" in picture and picture.count("<rect") == 4 and "left out" not in picture
    assert "2 deeper frames left out" in flame.svg(rows[:2]) and flame.svg([]).endswith("</svg>")
    assert flame.picture(spans(spark, TREE).limit(0)).collect() == []


def test_pictures_of_random_trees(spark):
    rng = random.Random(5)
    made = [(f"t{t}", f"{t}-{i}", "" if i == 0 else f"{t}-{rng.randrange(i)}", f"op{i % 3}", rng.randrange(5), 900 if i == 0 else rng.choice([0, 0.001, 0.4, 3, 700])) for t in range(60) for i in range(rng.randrange(1, 40))]
    df = spans(spark, made).withColumn("duration_ms", F.when(F.col("duration_ms") > 0, F.col("duration_ms")))
    found = {}
    for r in flame.picture(df, 900).collect():
        found.setdefault(r.trace_id, {})[r.span_id] = (r.x, r.y, r.width)
        assert r.shown >= 1
    walked = {}
    for r in flame.frames(trees.trees(df.fillna({"duration_ms": 0.0}))).orderBy("visit").collect():
        walked.setdefault(r.trace_id, []).append(r.asDict())
    assert found == {t: layout(rows, 900) for t, rows in walked.items()} and len(found) == 60


def test_picture_of_a_million_spans(spark):
    many = spark.range(1_000_000).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") == 0, "").otherwise(F.expr("(id - 1) div 10").cast("string")).alias("parent_span_id"), F.lit("s").alias("service_name"), F.lit("o").alias("operation"), F.lit("").alias("protocol"), F.col("id").alias("start_ns"), F.expr("1e6 / power(10, floor(log10(9 * id + 1)))").alias("duration_ms"))
    rows = flame.picture(many).collect()
    assert len(rows) == 1111 == rows[0].shown and rows[0].levels == 7


def test_sampler_rates(spark):
    cases = [((500, 1.0, 0.5), 1000, 0, 1.0), ((500, 1.0, 0.5), 100, 0, 0.5), ((500, 1.0, 0.5), 100, 404, 1.0), ((1000, 0.5, 0.001), 700, 0, 0.001), ((1000, 0.5, 0.001), 1500, 0, 0.5)]
    for config, ms, error, want in cases:
        df = spark.createDataFrame([(float(ms), error)], "duration_ms double, error_code int")
        assert df.select(sampling.rate(sampling.Rates(*config)).alias("r")).first().r == want


def test_sampler_draws(spark):
    df = spark.range(10_000).select(F.col("id").cast("string").alias("trace_id"))
    assert 50 <= df.filter(sampling.keeps(F.lit(0.01))).count() <= 150
    assert df.filter(sampling.keeps(F.lit(0.0))).count() == 0 and df.filter(sampling.keeps(F.lit(1.0))).count() == 10_000


def simulated(kinds):
    queue, pairs, orphans = deque(), [], []
    for i, k in enumerate(kinds):
        if k in ("open", "close"):
            queue.clear()
        elif k == "request":
            queue.append(i)
        elif queue:
            pairs.append((queue.popleft(), i))
        else:
            orphans.append(i)
    return pairs, orphans


def test_pairing_by_windows_equals_a_queue(spark):
    rng = random.Random(8)
    rows, want, lost = [], set(), set()
    for c in range(60):
        kinds = [rng.choices(["request", "response", "open", "close"], [5, 5, 1, 1])[0] for _ in range(40)]
        rows += [(f"c{c}", k, i * 1000, i, f"{c}-{i}", "t") for i, k in enumerate(kinds)]
        pairs, orphans = simulated(kinds)
        want |= {(f"{c}-{a}", f"{c}-{b}") for a, b in pairs}
        lost |= {f"{c}-{i}" for i in orphans}
    df = spark.createDataFrame(rows, correlate.EVENT)
    assert {(r.request_span, r.response_span) for r in correlate.pairs(df).collect()} == want
    assert {r.span_id for r in correlate.orphans(df).collect()} == lost
    replayed = correlate.replay(df).collect()
    assert {(r.parent_span_id, r.span_id) for r in replayed if r.parent_span_id} == want
    assert {r.span_id for r in replayed if r.tag == "orphan_response"} == lost


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["request", "response", "open", "close"]), max_size=60))
def test_connection_machine(kinds):
    c, found = correlate.Connection(), []
    for i, k in enumerate(kinds):
        found += c.see(dict(conn_key="c", kind=k, ts_ns=i, seq=i, span_id=i, trace_id="t"))
    pairs, orphans = simulated(kinds)
    assert [(p, e["span_id"]) for e, p, *_ in found if p is not None] == pairs
    assert [e["span_id"] for e, *_, tag in found if tag == "orphan_response"] == orphans


def test_bounded_queue_and_timeout():
    c = correlate.Connection(most=2, timeout_ns=10)
    event = lambda k, at: dict(conn_key="c", kind=k, ts_ns=at, seq=at, span_id=at, trace_id="t")
    assert [c.see(event("request", i)) for i in (1, 2)] == [[], []]
    (old, *_, tag) = c.see(event("request", 3))[0]
    assert (old["span_id"], tag) == (1, "evicted")
    assert [(e["span_id"], tag) for e, *_, tag in c.see(event("response", 50))] == [(2, "connection_timeout"), (3, "connection_timeout"), (50, "orphan_response")]


@settings(max_examples=20, deadline=None)
@given(ip=st.sampled_from(["10.0.0.1", "10.0.0.2", "9.9.9.9"]), other=st.sampled_from(["10.0.0.1", "10.0.0.2"]), a=st.integers(1, 3), b=st.integers(1, 3))
def test_connection_key_has_no_direction(spark, ip, other, a, b):
    key = lambda *x: scalars.connection_key(F.lit(7), *map(F.lit, x))
    row = spark.range(1).select(key(ip, a, other, b).alias("x"), key(other, b, ip, a).alias("y")).first()
    assert row.x == row.y


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abcxyz", min_size=1, max_size=4), st.text("abc=12", max_size=5), max_size=5))
def test_tags_round_trip(spark, given_):
    df = spark.createDataFrame([(given_,)], "m map<string,string>")
    row = df.select(scalars.text_to_tags(scalars.tags_to_text(F.col("m"))).alias("back")).first()
    assert row.back == given_


def test_default_detector_never_fires(spark):
    rng = random.Random(9)
    def alerts(d):
        s, n = anomaly.State(), 0
        for i in range(5000):
            n += s.add(d, 1000.0 if i % 100 == 99 else rng.uniform(5, 15), i)["is_anomaly"]
        return n
    assert alerts(anomaly.Detector()) == 0 and alerts(anomaly.Detector(0.2, 2.0)) == 0
    assert alerts(anomaly.Detector(0.05, 3.0)) > 0 and alerts(anomaly.Detector(mode="prior")) > 0


def test_detector_state():
    d, s = anomaly.Detector(0.05, 3.0, least=3, cooldown_s=60, idle_s=1000), anomaly.State()
    for i, x in enumerate([10.0, 10.0, 12.0]):
        r = s.add(d, x, i * 10**9)
    assert r["mean"] == pytest.approx(32 / 3) and r["stddev"] == pytest.approx(1.1547005)
    first, second = s.add(d, 500.0, 4 * 10**9), s.add(d, 9000.0, 5 * 10**9)
    assert first["is_sent"] and second["is_anomaly"] and (second["is_sent"] is (second["severity"] != first["severity"]))
    assert s.add(d, 10.0, 2000 * 10**9)["n"] == 1
    assert [d.severity(x) for x in (200, 201, 501)] == ["warning", "error", "critical"]


@pytest.mark.parametrize("mode", ["post", "prior"])
@pytest.mark.parametrize("slice_s", [1, 40, 10**6])
def test_slices_equal_the_fold_sample_by_sample(spark, slice_s, mode):
    """A hot key over many slices, idle gaps within and between them, null keys, ties in time, constants."""
    rng, at, rows = random.Random(5), 0, []
    for i in range(3000):
        at += rng.choice([0, 10**7, 10**8, 10**9, 35 * 10**9] if i % 50 == 0 else [0, 10**7, 3 * 10**8])
        key = rng.choice([("hot", "a", "http")] * 8 + [("hot", None, "http"), (None, None, None), ("flat", "b", "x")])
        x = 7.3 if key[0] == "flat" else rng.choice([5.0, 6.0, 7.5, 9.0]) if rng.random() < 0.9 else rng.uniform(10, 900)
        rows.append(("t", f"{i:06}", *key, at, x))
    rows += [("t", "null", "hot", "a", "http", 5, None), ("t", "zero", "hot", "a", "http", 5, 0.0), ("t", "never", "hot", "a", "http", None, 4.0)]
    d = anomaly.Detector(0.05, 2.0, least=5, cooldown_s=20, idle_s=9, mode=mode)
    states, want = {}, {}
    for _, span, *key, at, x in sorted(rows[:3000], key=lambda r: (r[5], r[1])):
        want[span] = states.setdefault(tuple(key), anomaly.State()).add(d, x, at)
    spans = spark.createDataFrame(rows, anomaly.SAMPLE).repartition(3)
    folded = anomaly.fold(spans, d, slice_s)
    got = {r.span_id: r for r in folded.collect()}
    assert got.keys() == want.keys() and len({r["n"] for r in want.values()}) > 50
    for span, w in want.items():
        for c in ("n", "is_anomaly", "severity"):
            assert got[span][c] == w[c], (span, c)
        for c in ("mean", "stddev", "ewma", "ewma_var", "threshold", "deviation"):
            assert got[span][c] == pytest.approx(w[c], rel=1e-9, abs=1e-6), (span, c)
    told = {r.span_id: r.is_sent for r in anomaly.sent(folded, d).collect()}
    assert told == {span: w["is_sent"] for span, w in want.items() if w["is_anomaly"]} and len(set(told.values())) == 2
    empty = spark.createDataFrame([], anomaly.SAMPLE)
    assert anomaly.fold(empty, d).count() == 0 and anomaly.sent(anomaly.fold(empty, d), d).count() == 0


def test_similarity_is_of_a_set_and_a_bag(spark):
    f = lambda a, b: value(spark, similarity.similarity(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert f("ab", "ab") == 1 and f("aab", "ab") == 1 and f("ab", "aab") == pytest.approx(3 / 2) and f("ab", "cd") == 0


def test_search_defaults():
    q = TraceQuery(least_ms=0, limit=-1, offset=-5).with_defaults()
    assert (q.limit, q.offset, q.least_ms) == (20, 0, None) and q.end_us - q.start_us == 24 * 3600 * 10**6
    assert TraceQuery(start_us=5, end_us=9, limit=3).with_defaults().start_us == 5


def test_tables_round_trip(spark, tmp_path):
    df = raw.spans(raw.events(record(spark))).unionByName(raw.spans(raw.events(record(spark, timestamp=1_600_000_000_000_000_000, trace_id="x" * 32, span_id="s"))))
    bad = df.limit(1).withColumn("span_id", F.lit(""))
    tables.write_spans(df.unionByName(bad), str(tmp_path / "spans"), str(tmp_path / "bad"))
    assert sorted(p.name for p in (tmp_path / "spans").glob("month=*")) == ["month=202009", "month=202311"]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    back = tables.read_spans(spark, str(tmp_path / "spans"), start="2023-01-01")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()
    whole, day = tables.read_spans(spark, str(tmp_path / "spans")), 86_400_000_000
    since = 1_672_531_200_000_000  # 2023-01-01
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(stats.service_stats(whole, None, since, since + 400 * day)).count("(month#") and "month" in plan(search.matching(whole, TraceQuery(start_us=since))).split("PartitionFilters: [")[1].split("]")[0]
    both = plan(stats.service_map(whole, since, since + day, longest_us=day)).split("PartitionFilters: [")[1:]
    assert len(both) == 2 and all("month" in p.split("]")[0] for p in both)
    assert stats.service_stats(whole, None, since, since + 400 * day).count() == 1 and "month" not in search.search(whole, TraceQuery(limit=1)).columns
    assert tables.retained(back, 30, 1_700_000_000_000_000).count() == 1 and tables.retained(back, 30).count() == 0


def test_capture_files(spark, tmp_path):
    body = bytes(record(spark, pid=1).first().record) + bytes(record(spark, pid=2).first().record) + b"rest"
    (tmp_path / "one.bin").write_bytes(body)
    (tmp_path / "none.bin").write_bytes(b"")
    got = codec.decode(raw.read_records(spark, str(tmp_path))).orderBy("pid").collect()
    assert [(r.pid, r.record_nr) for r in got] == [(1, 0), (2, 1)]


def test_retries():
    waits, calls = [], []
    def send():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("Too many parts" if len(calls) == 2 else "no")
    assert tables.with_retries(send, wait=waits.append) == 3
    assert waits == pytest.approx([0.2, 2.4, 0.8])
    with pytest.raises(OSError):
        tables.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), retries=1, wait=waits.append)
    assert [tables.flush_seconds(n) for n in (1, 20_000, 10**6)] == [10, 20, 60]


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("sampling: {low: 0.5}\nstorage: {batch_size: 7}\n")
    monkeypatch.setenv("TRACESPARK_SAMPLING_HIGH", "0.9")
    c = tables.load_config(str(tmp_path / "c.yaml"))
    assert (c.sampling.low, c.sampling.high, c.storage.batch_size, c.anomaly.k) == (0.5, 0.9, 7, 3.0)
    assert c.storage.dsn() == "tcp://localhost:9000/traces?username=default" and tables.load_config().sampling.low == 0.01
    (tmp_path / "d.yaml").write_text("protocols: {http: [81], redis: []}\nalerts: {enabled: true}\nflamegraph: {width: 900}\n")
    monkeypatch.setenv("TRACESPARK_PROTOCOLS_GRPC", "50051,7001")
    monkeypatch.setenv("TRACESPARK_COMPRESSION_ENABLED", "false")
    d = tables.load_config(str(tmp_path / "d.yaml"))
    assert d.ports() == {"http": (81,), "grpc": (50051, 7001)} and d.alerts.enabled and d.flamegraph.width == 900 and not d.compression.enabled
    assert d.detector() == anomaly.Detector() and d.rates() == sampling.Rates(500, 0.9, 0.01)


def test_create_table(spark, tmp_path):
    tables.create_table(spark, "spans_of_test", str(tmp_path / "t"))
    assert "month" in spark.table("spans_of_test").columns
    spark.sql("DROP TABLE spans_of_test")
