from pyspark.sql import functions as F

from tracespark.functions import protocols as P


def one(spark, payload, column):
    return spark.createDataFrame([(None if payload is None else bytearray(payload),)], "p binary").select(column(F.col("p")).alias("v")).first().v


def frame(inner, kind=1, flags=0, magic=b"ENVY"):
    return magic + bytes([1, kind, flags, 0]) + (7).to_bytes(8, "big") + len(inner).to_bytes(4, "big") + (9).to_bytes(8, "big") + inner


def grpc(head, status=0):
    inner = b"\0" + len(head).to_bytes(4, "big") + head
    return bytes([status]) + len(inner).to_bytes(4, "big") + inner


def test_http(spark):
    r = one(spark, b"POST /a?b HTTP/1.1\r\nHost: x\r\nX-TRACE-ID: t1\r\nx-span-id: s\r\nX-Parent-Span-Id: p\r\nDup: 1\r\nDup: 2\r\nbroken\r\n\r\nbody: x\r\n\r\nmore", P.http)
    assert (r.method, r.path, r.version, r.trace_id, r.span_id, r.parent_span_id, r.body) == ("POST", "/a?b", "1.1", "t1", "s", "p", "body: x\r\n\r\nmore")
    assert r.headers["Dup"] == "2" and "broken" not in r.headers and "body" not in r.headers
    r = one(spark, b"HTTP/1.0 503 Service Unavailable\r\n\r\n", P.http)
    assert (r.is_request, r.status, r.version, r.body) == (False, 503, "1.0", None)
    for bad in (b"", b"GET", b"GET /x", b"HTTP/1.1 abc", b"PROPFIND / HTTP/1.1", b"\xff\xfe\xfd\xfc", None):
        assert one(spark, bad, P.http) is None


def test_grpc(spark):
    r = one(spark, grpc(b":path: /svc.A/Get\r\nx-trace-id:t\r\nkey : v \r\n\r\nlate: 1"), P.grpc)
    assert (r.service, r.method, r.status, r.trace_id, r.metadata["key"]) == ("svc.A", "Get", 0, "t", "v") and "late" not in r.metadata
    outside = b"\0\0\0\0\x09" + b"\x01/svc.B/Put\0\0\0x"
    assert P.parse_grpc(outside)["service"] == "\x01" or P.parse_grpc(outside)["method"]
    clean = b"\0\0\0\0\0" + b"/svc.B/Put\0\0\0x"
    assert (P.parse_grpc(clean)["service"], P.parse_grpc(clean)["method"]) == ("svc.B", "Put")
    assert (P.parse_grpc(clean, compat=True)["service"], P.parse_grpc(clean, compat=True)["method"]) == ("", "svc.B")
    assert P.parse_grpc(b"\2\0\0\0\0") is None and P.parse_grpc(b"\0\0") is None and P.parse_grpc(None) is None
    assert P.parse_grpc(b"\1\0\0\0\0")["status"] == 1
    assert P.parse_grpc(b"\0\0\0\0\0" + b"\0\xff\xff\xff\xffx")["metadata"] == {}


def test_redis(spark):
    r = one(spark, b"*3\r\n$3\r\nset\r\n$1\r\nk\r\n$1\r\nv\r\n*1\r\n$4\r\nPING\r\n", P.redis)
    assert [(c.command, c.key, c.args) for c in r] == [("SET", "k", ["v"]), ("PING", "", [])]
    assert [(c["command"], c["key"], c["is_response"]) for c in P.parse_redis(b"+OK\r\n-ERR x\r\n:5\r\n$-1\r\n")] == [("+", "OK", True), ("-", "ERR x", True), (":", "5", True), ("$", "-1", True)]
    assert P.parse_redis(b"$5\r\nhello\r\n")[0]["args"] == ["hello"]
    assert P.parse_redis(b"get k a b\r\n") is None and P.parse_redis(b"GET k a b\n")[0]["args"] == ["a", "b"]
    assert P.parse_redis(b"*2\r\n$3\r\nGET\r\n$10\r\nshort")[0]["command"] == "GET"
    assert P.parse_redis(b"*x\r\n") is None and P.parse_redis(b"*-1\r\n") is None and P.parse_redis(b"") is None
    assert len(P.parse_redis(b"+OK\r\n*x\r\n")) == 1
    assert one(spark, b"\x00abc", P.redis) is None and one(spark, None, P.redis) is None


def test_frames(spark):
    r = one(spark, frame(b"GET / HTTP/1.1\r\n", 1, 1), P.framed)
    assert (r.type, r.stream_id, r.timestamp, r.protocol, r.is_request, r.is_udp, r.operation) == ("DATA", 7, 9, "http", True, True, "ENVOY_DATA_HTTP")
    assert one(spark, frame(b"HTTP/1.1 200 OK\r\n", 9), P.framed).operation == "ENVOY_UNKNOWN_9_HTTP"
    assert one(spark, frame(b"xx", 1, 2), P.framed).is_request is False and one(spark, frame(b"xx", 1), P.framed).is_request is True
    for inner, name in ((b"", ""), (b"PRI * x", "redis"), (b"\0\0\0\0\5abcde", "grpc"), (b"\1\2x", "mysql"), (b"zzzz", "unknown")):
        assert one(spark, frame(inner), P.framed).protocol == name
    for bad in (b"", b"ENVY", frame(b"x", magic=b"ENVX"), b"\0" * 16, None):
        assert one(spark, bad, P.framed) is None and one(spark, bad, P.unframed) == bad
    assert P.split_frames(frame(b"a") + frame(b"bc") + b"ENVY") == [frame(b"a"), frame(b"bc")]
    assert P.split_frames(frame(b"abc")[:-1]) == [] and P.split_frames(None) == []


def test_dispatch(spark):
    rows = [(1, "http", b"GET /x HTTP/1.1\r\n\r\n"), (2, "grpc", grpc(b":path: /s/m\r\n", 1)), (3, "redis", b"*2\r\n$3\r\nget\r\n$1\r\nk\r\n"), (4, "http", frame(b"GET /in HTTP/1.1\r\n\r\n")), (5, "http", b""), (6, "unknown", b"abc"), (7, "http", None), (8, "redis", frame(b"zz"))]
    df = spark.createDataFrame([(i, p, None if b is None else bytearray(b)) for i, p, b in rows], "i int, protocol string, payload binary")
    got = {r.i: r for r in P.parse(df).collect()}
    assert [got[i].parsed_operation for i in range(1, 9)] == ["GET /x", "s/m", "GET k", "GET /in", None, None, None, "ENVOY_DATA_UNKNOWN"]
    assert got[2].parsed_error_code == 1 and got[4].parsed_path == "/in" and got[3].redis_tags.redis_command_count == 1 and got[6].raw == "abc"
    assert '"method":"GET"' in P.info_json(P.parse(df)).filter("i = 1").first().info


def test_http_is_parted_once_and_makes_what_is_asked_for(spark):
    payload = b"GET /a HTTP/1.1\r\nX-Trace-Id: t\r\nk: 1\r\nk: 2\r\n\r\nbody\r\n\r\nmore"
    made = spark.createDataFrame([(payload,), (b"HTTP/1.0 404 Not Found",), (b"GET no version",), (None,)], "payload binary")
    whole = made.select(P.http(F.col("payload")).alias("h"))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("validate_utf8") + plan.lower().count("makevalid") + plan.lower().count("make_valid") <= 1
    rows = [r.h for r in whole.collect()]
    assert rows[0].asDict() == dict(is_request=True, method="GET", path="/a", version="1.1", status=None, headers={"X-Trace-Id": "t", "k": "2"}, body="body\r\n\r\nmore", trace_id="t", span_id=None, parent_span_id=None)
    assert (rows[1].is_request, rows[1].status, rows[1].version, rows[1].headers, rows[1].body) == (False, 404, "1.0", {}, None) and rows[2:] == [None, None]
    line = made.select(P.http(F.col("payload"), ("method", "path")).alias("h")).select("h.*")
    assert "instr" not in line._jdf.queryExecution().optimizedPlan().toString() and line.first() == ("GET", "/a")
