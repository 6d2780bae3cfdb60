"""Queries and oracles of scalar functions, decoding, projections and protocol parsers. Inputs are made
from the events table on the Spark side; the oracles state the expected values directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, protocols
from ..functions import scalars as S
from ..operators import correlate
from ..sources import raw, tables
from .registry import register
from .views import nanos, raw_records, spans, table

col, lit = F.col, F.lit
text = lambda c: col(c).cast("string")
ID = "event_id"


def e(s, d):
    return table(s, d, "events").repartition(s.sparkContext.defaultParallelism).withColumn("ns", nanos(col("ts")))


def scalar(name, spark, duck):
    """One function of an event, as column `value`."""
    register(name, lambda s, d: e(s, d).select(ID, spark().alias("result")), f"SELECT event_id, {duck} AS result FROM events")


US = "epoch_us(ts)"
scalar("S01_event_name", lambda: S.event_name(col(ID) % 7), "CASE event_id % 7 WHEN 0 THEN 'connect' WHEN 1 THEN 'accept' WHEN 2 THEN 'send' WHEN 3 THEN 'recv' WHEN 4 THEN 'close' ELSE 'unknown' END")
scalar("S02_protocol_name", lambda: S.protocol_name(col(ID) % 5), "CASE event_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'grpc' WHEN 2 THEN 'redis' ELSE 'unknown' END")
scalar("S03_dotted_address", lambda: S.dotted(col(ID) * 65537 + 16777343), "((event_id * 65537 + 16777343) & 255) || '.' || ((event_id * 65537 + 16777343) // 256 & 255) || '.' || ((event_id * 65537 + 16777343) // 65536 & 255) || '.' || ((event_id * 65537 + 16777343) // 16777216 & 255)")
scalar("S04_swapped_port", lambda: S.swapped_port(col(ID) % 65536), "CAST(event_id % 65536 % 256 * 256 + event_id % 65536 // 256 AS INT)")
scalar("S05_from_nanos", lambda: F.unix_micros(S.from_nanos(col("ns"))), US)
scalar("S06_from_millis", lambda: F.unix_micros(S.from_millis(F.expr("ns div 1000000"))), f"{US} // 1000 * 1000")
scalar("S07_minute", lambda: S.minute_us(F.expr("ns div 1000")), "epoch_us(date_trunc('minute', ts))")
scalar("S08_month", lambda: S.month(col("ts")), "strftime(ts, '%Y%m')")
scalar("S09_end_of_span", lambda: F.expr("ns div 1000") + S.whole_micros(col("value")), f"{US} + CAST(floor(value * 1000) AS BIGINT)")
scalar("S10_millis", lambda: S.millis(col(ID) * 1500), "event_id * 1500 / 1e6")
scalar("S11_whole_micros", lambda: S.whole_micros(col("value")), "CAST(floor(value * 1000) AS BIGINT)")
scalar("S12_root_of_positive_part", lambda: F.round(F.sqrt(F.greatest(lit(0.0), col("value") - 50)), 9), "round(sqrt(greatest(0.0, value - 50)), 9)")
scalar("S13_hashed_id", lambda: S.hashed_id(text(ID), 16), "substr(sha256(CAST(event_id AS VARCHAR)), 1, 16)")
scalar("S14_connection_trace_id", lambda: S.connection_trace_id(col("user_id"), lit("10.0.0.1"), col(ID) % 60000, lit("10.0.0.2"), lit(8080), col("ns"), col("event_type")), f"substr(sha256(concat_ws(':', user_id, '10.0.0.1', event_id % 60000, '10.0.0.2', 8080, {US} * 1000, event_type)), 1, 32)")
BYTES = "list_transform(string_split(event_type || ':' || event_id, ''), lambda c: ascii(c)::HUGEINT)"
scalar("S15_fnv_64", lambda: S.fnv1a_64(F.concat("event_type", lit(":"), text(ID))), f"lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, {BYTES}), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)), 16, '0'))")
scalar("S16_fnv_32", lambda: S.fnv1a_32(F.concat("event_type", lit(":"), text(ID))), f"CAST(list_reduce(list_prepend(2166136261::HUGEINT, {BYTES}), lambda h, c: (xor(h, c) * 16777619::HUGEINT) % 4294967296::HUGEINT) AS BIGINT)")
A, B, PA, PB = "'10.0.0.' || event_id % 7", "'10.0.0.' || event_id % 5", "event_id % 11", "event_id % 13"
scalar("S17_connection_key", lambda: S.connection_key(col("user_id"), F.concat(lit("10.0.0."), (col(ID) % 7).cast("string")), col(ID) % 11, F.concat(lit("10.0.0."), (col(ID) % 5).cast("string")), col(ID) % 13),
       f"CASE WHEN {A} > {B} OR ({A} = {B} AND {PA} > {PB}) THEN concat_ws(':', user_id, {B}, {PB}, {A}, {PA}) ELSE concat_ws(':', user_id, {A}, {PA}, {B}, {PB}) END")
tags = lambda: F.create_map(lit("b"), col("event_type"), lit("a"), text(ID))
scalar("S18_tags_to_text", lambda: S.tags_to_text(tags()), "'a=' || event_id || ',b=' || event_type")
loose = lambda: F.concat(lit("x,k="), text(ID), lit(",q=1=2,k="), col("event_type"))
scalar("S19_text_to_tags", lambda: F.concat_ws("|", S.text_to_tags(loose())["k"], S.text_to_tags(loose())["q"], F.size(S.text_to_tags(loose())).cast("string")), "event_type || '|1=2|2'")
scalar("S20_truncated", lambda: S.truncated(F.repeat(col("event_type"), 4), 20), "CASE WHEN length(repeat(event_type, 4)) > 20 THEN left(repeat(event_type, 4), 20) || '...' ELSE repeat(event_type, 4) END")
scalar("S23_described", lambda: S.described(text("user_id"), text(ID), lit("svc"), col("event_type"), col("value")), "format('Span[trace={}, span={}, service=svc, op={}, dur={:.2f}ms]', user_id, event_id, event_type, value)")
scalar("S24_frame_name", lambda: S.frame_name(lit("svc"), col("event_type"), F.when(col(ID) % 2 == 0, "http").otherwise("")), "'svc:' || event_type || CASE WHEN event_id % 2 = 0 THEN ' [http]' ELSE '' END")
scalar("S26_set_tag", lambda: S.tags_to_text(S.set_tag(tags(), "a", lit("new"))), "'a=new,b=' || event_type")
scalar("S27_redis_trace_id", lambda: S.redis_trace_id(F.concat(F.when(col(ID) % 3 == 0, "").otherwise("SET "), lit("TRACE_ID:t"), text("user_id"), lit(" x"))), "CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || user_id END")
scalar("PRJ03_padded", lambda: F.length(S.padded(text(ID), 16)), "16")
scalar("PRJ04_unpadded", lambda: S.unpadded(S.padded(F.concat(lit(" "), text(ID)), 16)), "CAST(event_id AS VARCHAR)")
SP, DP = "event_id % 70000", "CASE event_id % 9 WHEN 0 THEN 80 WHEN 1 THEN 50051 WHEN 2 THEN 6379 WHEN 3 THEN 9000 ELSE 1 END"
scalar("FLT07_protocol_of_ports", lambda: protocols.protocol_of_ports(F.expr(DP), F.expr(SP)), f"CASE WHEN {DP} IN (80, 8080, 3000, 8000, 9090) OR {SP} IN (80, 8080, 3000, 8000, 9090) THEN 'http' WHEN {DP} IN (50051, 9000, 7000) OR {SP} IN (50051, 9000, 7000) THEN 'grpc' WHEN {DP} = 6379 OR {SP} = 6379 THEN 'redis' ELSE 'unknown' END")

# Payloads

binary = lambda *cs: F.encode(F.concat(*cs), "UTF-8")
be = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * size, "0"))


def http_payload():
    request = binary(lit("GET /"), col("event_type"), lit("/"), text(ID), lit(" HTTP/1.1\r\nHost: svc\r\nX-Trace-Id: t"), text("user_id"), lit("\r\nX-Dup: a\r\nX-Dup: b\r\n\r\nbody-"), text(ID))
    response = binary(lit("HTTP/1.0 "), (col(ID) % 300 + 200).cast("string"), lit(" OK\r\nx-span-id: s"), text(ID), lit("\r\n\r\n"))
    return F.when(col(ID) % 2 == 0, request).otherwise(response)


def grpc_payload():
    head = binary(lit(":path: /svc."), col("event_type"), lit("/m"), text(ID), lit("\r\nx-trace-id: t"), text("user_id"), lit("\r\n"))
    inner = F.concat(F.unhex(lit("00")), be(F.length(head), 4), head)
    return F.concat(be(col(ID) % 2, 1), be(F.length(inner), 4), inner)


def redis_payload():
    key = F.concat(lit("k:"), text(ID))
    pipeline = binary(lit("*3\r\n$3\r\nset\r\n$"), F.length(key).cast("string"), lit("\r\n"), key, lit("\r\n$1\r\nv\r\n*2\r\n$3\r\nGET\r\n$1\r\nx\r\n"))
    reply = binary(lit("$"), F.length("event_type").cast("string"), lit("\r\n"), col("event_type"), lit("\r\n"))
    inline = binary(lit("Ping "), col("event_type"), lit(" z\r\n"))
    return F.when(col(ID) % 3 == 0, pipeline).when(col(ID) % 3 == 1, reply).otherwise(inline)


def frame_payload():
    inner = http_payload()
    return F.concat(F.unhex(lit("454E565901")), be(col(ID) % 7, 1), be(col(ID) % 4, 1), F.unhex(lit("00")), be(col(ID), 8), be(F.length(inner), 4), be(col("user_id"), 8), inner)


def parsed(payload, parse):
    return lambda s, d: e(s, d).withColumn("payload", payload()).withColumn("p", parse(col("payload")))


def over(name, made, columns, duck):
    register(name, lambda s, d: made(s, d).select(ID, *[c.alias(n) for n, c in columns().items()]), f"SELECT event_id, {duck} FROM events")


EVEN = "event_id % 2 = 0"
req = lambda x: f"CASE WHEN {EVEN} THEN {x} END"
res = lambda x: f"CASE WHEN NOT ({EVEN}) THEN {x} END"
http = lambda *fields: parsed(http_payload, lambda p: protocols.http(p, fields))
over("PP01_looks_http", parsed(redis_payload, protocols.looks_http), lambda: {"result": col("p")}, "false AS result")
over("PP02_http_request_line", http("method", "path"), lambda: {"method": col("p.method"), "path": col("p.path")}, f"{req(repr('GET'))} AS method, {req(chr(39) + '/' + chr(39) + ' || event_type || ' + chr(39) + '/' + chr(39) + ' || event_id')} AS path")
over("PP03_http_response_line", http("status", "version"), lambda: {"status": F.coalesce("p.status", lit(0)), "version": col("p.version")}, f"CAST(coalesce({res('event_id % 300 + 200')}, 0) AS INT) AS status, CASE WHEN {EVEN} THEN '1.1' ELSE '1.0' END AS version")
over("PP04_http_headers", http("headers"), lambda: {"n": F.size("p.headers"), "dup": col("p.headers")["X-Dup"]}, f"CASE WHEN {EVEN} THEN 3 ELSE 1 END AS n, {req(repr('b'))} AS dup")
over("PP05_trace_context", http("trace_id", "span_id"), lambda: {"trace_id": col("p.trace_id"), "span_id": col("p.span_id")}, f"CASE WHEN {EVEN} THEN 't' || user_id END AS trace_id, CASE WHEN NOT ({EVEN}) THEN 's' || event_id END AS span_id")
over("PP06_http_body", http("body"), lambda: {"body": col("p.body")}, f"CASE WHEN {EVEN} THEN 'body-' || event_id END AS body")
grpc = parsed(grpc_payload, protocols.grpc)
over("PP08_looks_grpc", parsed(http_payload, protocols.looks_grpc), lambda: {"result": col("p")}, "false AS result")
over("PP09_grpc_frame", grpc, lambda: {"status": col("p.status"), "trace_id": col("p.trace_id")}, "CAST(event_id % 2 AS INT) AS status, 't' || user_id AS trace_id")
over("PP10_grpc_path", grpc, lambda: {"service": col("p.service"), "method": col("p.method")}, "'svc.' || event_type AS service, 'm' || event_id AS method")
redis = parsed(redis_payload, protocols.redis)
THREE = lambda a, b, c: f"CASE event_id % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
first = lambda: F.get("p", lit(0))
over("PP12_looks_redis", parsed(redis_payload, protocols.looks_redis), lambda: {"result": col("p")}, "true AS result")
over("PP13_redis_commands", redis, lambda: {"n": F.size("p")}, f"{THREE('2', '1', '1')} AS n")
over("PP14_resp_arrays", redis, lambda: {"command": first()["command"], "key": first()["key"]}, f"{THREE(repr('SET'), repr('$'), repr('PING'))} AS command, {THREE(chr(39) + 'k:' + chr(39) + ' || event_id', 'CAST(length(event_type) AS VARCHAR)', 'event_type')} AS key")
over("PP15_resp_replies", redis, lambda: {"is_response": first()["is_response"], "arg": F.get(first()["args"], lit(0))}, f"event_id % 3 = 1 AS is_response, {THREE(repr('v'), 'event_type', repr('z'))} AS arg")
over("PP16_inline_commands", redis, lambda: {"args": F.array_join(first()["args"], ",")}, f"{THREE(repr('v'), 'event_type', repr('z'))} AS args")
tagged = lambda s, d: redis(s, d).withColumn("t", protocols.redis_tags(col("p")))
over("PP17_redis_pipelines", tagged, lambda: {"redis_command_count": col("t.redis_command_count"), "redis_pipeline": col("t.redis_pipeline")}, f"{THREE('2', '1', '1')} AS redis_command_count, event_id % 3 = 0 AS redis_pipeline")
over("AGG16_redis_keys", tagged, lambda: {"keys": F.array_join("t.redis_keys", ",")}, f"{THREE(chr(39) + 'k:' + chr(39) + ' || event_id || ' + chr(39) + ',x' + chr(39), 'CAST(length(event_type) AS VARCHAR)', 'event_type')} AS keys")
framed = parsed(frame_payload, protocols.framed)
TYPE = "CASE event_id % 7 WHEN 1 THEN 'DATA' WHEN 2 THEN 'HANDSHAKE' WHEN 3 THEN 'ACK' WHEN 4 THEN 'KEEPALIVE' WHEN 5 THEN 'RESET' ELSE 'UNKNOWN_' || event_id % 7 END"
over("PP18_looks_framed", parsed(frame_payload, protocols.looks_framed), lambda: {"result": col("p")}, "true AS result")
over("PP19_frame_header", framed, lambda: {"version": col("p.version"), "stream_id": col("p.stream_id").cast("long"), "flags": col("p.flags"), "time": col("p.timestamp").cast("long")}, "CAST(1 AS BIGINT) AS version, event_id AS stream_id, event_id % 4 AS flags, user_id AS time")
over("PP20_frame_operation", framed, lambda: {"operation": col("p.operation"), "is_udp": col("p.is_udp")}, f"'ENVOY_' || {TYPE} || '_HTTP' AS operation, event_id % 4 IN (1, 3) AS is_udp")
over("PP21_inner_protocol", framed, lambda: {"protocol": col("p.protocol")}, "'http' AS protocol")
over("PP22_frame_is_request", framed, lambda: {"is_request": col("p.is_request")}, f"event_id % 4 < 2 AND {EVEN} AS is_request")
over("PP23_message_type", framed, lambda: {"type": col("p.type")}, f"{TYPE} AS type")
register("PP24_frames", lambda s, d: protocols.frames(e(s, d).select(ID, F.concat(frame_payload(), frame_payload(), F.unhex(lit("454E"))).alias("payload"))).select(ID, "frame", col("framed.stream_id").cast("long").alias("stream_id")), "SELECT event_id, unnest([0, 1]) AS frame, event_id AS stream_id FROM events")
over("PP25_unframed", parsed(frame_payload, lambda p: protocols.unframed(p)), lambda: {"path": F.when(col(ID) % 2 == 0, F.split_part(protocols.text(col("p")), lit(" "), lit(2)))}, f"CASE WHEN {EVEN} THEN '/' || event_type || '/' || event_id END AS path")
over("PP26_kernel_path", parsed(http_payload, protocols.kernel_path), lambda: {"path": col("p")}, f"CASE WHEN {EVEN} THEN '/' || event_type || '/' || event_id ELSE '' END AS path")


def dispatched(s, d):
    kind = F.when(col(ID) % 3 == 0, "http").when(col(ID) % 3 == 1, "grpc").otherwise("redis")
    payload = F.when(col(ID) % 3 == 0, http_payload()).when(col(ID) % 3 == 1, grpc_payload()).otherwise(redis_payload())
    return protocols.parse(e(s, d).select(ID, "event_type", "user_id", payload.alias("payload"), kind.alias("protocol")))


OP = f"CASE event_id % 3 WHEN 0 THEN {req(chr(39) + 'GET /' + chr(39) + ' || event_type || ' + chr(39) + '/' + chr(39) + ' || event_id')} WHEN 1 THEN 'svc.' || event_type || '/m' || event_id ELSE 'PING ' || event_type END"
over("PP00_dispatcher", dispatched, lambda: {"operation": col("parsed_operation"), "trace_id": col("parsed_trace_id")}, f"{OP} AS operation, CASE event_id % 3 WHEN 0 THEN {req(chr(39) + 't' + chr(39) + ' || user_id')} WHEN 1 THEN 't' || user_id END AS trace_id")
over("S21_to_json", lambda s, d: protocols.info_json(dispatched(s, d)), lambda: {"status": F.get_json_object("info", "$.http.status").cast("int"), "has_raw": F.get_json_object("info", "$.raw").isNotNull()}, f"CAST(CASE WHEN event_id % 3 = 0 THEN {res('event_id % 300 + 200')} END AS INT) AS status, true AS has_raw")
over("PP07_http_operation", dispatched, lambda: {"error_code": F.coalesce(F.when(col("protocol") == "http", col("parsed_error_code")), lit(0))}, f"CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN {res('event_id % 300 + 200')} END, 0) AS INT) AS error_code")
over("PP11_grpc_operation", dispatched, lambda: {"operation": F.when(col("protocol") == "grpc", col("parsed_operation"))}, "CASE WHEN event_id % 3 = 1 THEN 'svc.' || event_type || '/m' || event_id END AS operation")
over("FLT05_request_payloads", parsed(http_payload, correlate.is_request), lambda: {"result": col("p")}, f"{EVEN} AS result")
over("FLT06_response_payloads", parsed(http_payload, correlate.is_response), lambda: {"result": col("p")}, f"NOT ({EVEN}) AS result")

# Raw records

register("SRC11_decoded_records", lambda s, d: codec.decode(raw_records(s, d)).select(ID, col("timestamp").alias("at"), "pid", "tid", "comm", "event_type", "protocol", "saddr", "sport", "dport", "duration_ns", "error_code", "payload_size", "path"),
         """SELECT event_id, epoch_us(ts) * 1000 AS at, user_id AS pid, event_id % 100000 AS tid, event_type AS comm, event_id % 5 AS event_type, event_id % 4 AS protocol, 16777343 + event_id % 100 * 16777216 AS saddr, event_id % 60000 + 1 AS sport, 36895 AS dport,
         CAST(floor(value * 1000000) AS BIGINT) AS duration_ns, CASE event_type WHEN 'error' THEN -111 ELSE 200 END AS error_code,
         length('GET /' || event_type || '/' || event_id || ' HTTP/1.1' || chr(13) || chr(10) || 'x-trace-id: t' || user_id || chr(13) || chr(10) || chr(13) || chr(10)) AS payload_size, '/' || event_type AS path FROM events""")
SOURCE = "'127.0.0.' || (16777343 + event_id % 100 * 16777216) // 16777216"
for number, (key, condition, duck) in {
    1: ("connects", "event = 'connect'", "event_id % 5 = 0"),
    2: ("failed_connects", "failed_connect", "event_id % 5 = 0 AND event_type = 'error'"),
    3: ("accepts", "event = 'accept'", "event_id % 5 = 1"),
    4: ("datagram_sends", "event = 'send' AND path = '/view'", "event_id % 5 = 2 AND event_type = 'view'"),
    5: ("datagram_receives", "event = 'recv' AND path = '/view'", "event_id % 5 = 3 AND event_type = 'view'"),
    6: ("sends", "event = 'send'", "event_id % 5 = 2"),
    7: ("receives", "event = 'recv' AND payload_size > 0", "event_id % 5 = 3"),
    8: ("closes", "event = 'close'", "event_id % 5 = 4"),
}.items():
    register(f"SRC0{number}_{key}", lambda s, d, c=condition: raw.events(raw_records(s, d)).filter(c).select(ID, "source_ip", "dest_port"), f"SELECT event_id, {SOURCE} AS source_ip, CASE WHEN event_id % 5 IN (1, 3) THEN 36895 ELSE 8080 END AS dest_port FROM events WHERE {duck}")
register("SRC09_common_fields", lambda s, d: raw.events(raw_records(s, d)).select(ID, "start_ns", "pid", "uid", "gid", "comm"), "SELECT event_id, epoch_us(ts) * 1000 AS start_ns, user_id AS pid, 1000::BIGINT AS uid, 1000::BIGINT AS gid, event_type AS comm FROM events")
made = lambda s, d: raw.spans(raw.events(raw_records(s, d)))
register("PRJ01_spans_of_records", lambda s, d: made(s, d).select("trace_id", "service_name", "operation", "protocol", "event_type", F.expr("start_ns div 1000").alias("start_us"), F.round("duration_ms", 6).alias("duration_ms"), "source_port", "error_code"),
         """SELECT CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 3 AND event_id % 5 NOT IN (1, 3)) THEN 't' || user_id ELSE substr(sha256(concat_ws(':', user_id, '127.0.0.' || (16777343 + event_id % 100 * 16777216) // 16777216, CASE WHEN event_id % 5 IN (1, 3) THEN (event_id % 60000 + 1) % 256 * 256 + (event_id % 60000 + 1) // 256 ELSE event_id % 60000 + 1 END, '127.0.0.2', CASE WHEN event_id % 5 IN (1, 3) THEN 36895 ELSE 8080 END, epoch_us(ts) * 1000, event_type)), 1, 32) END AS trace_id,
         event_type AS service_name, CASE WHEN event_id % 4 = 1 OR (event_id % 4 = 3 AND event_id % 5 IN (1, 3)) THEN k ELSE 'GET /' || event_type || '/' || event_id END AS operation,
         CASE WHEN event_id % 4 = 0 THEN 'http' WHEN event_id % 4 = 1 THEN 'grpc' WHEN event_id % 4 = 2 THEN 'redis' WHEN event_id % 5 IN (1, 3) THEN pr ELSE 'http' END AS protocol, k AS event_type, epoch_us(ts) AS start_us, round(floor(value * 1000000) / 1e6, 6) AS duration_ms,
         CAST(CASE WHEN event_id % 5 IN (1, 3) THEN (event_id % 60000 + 1) % 256 * 256 + (event_id % 60000 + 1) // 256 ELSE event_id % 60000 + 1 END AS INT) AS source_port, CASE event_type WHEN 'error' THEN -111 ELSE 200 END AS error_code
         FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'connect' WHEN 1 THEN 'accept' WHEN 2 THEN 'send' WHEN 3 THEN 'recv' ELSE 'close' END AS k, 'unknown' AS pr FROM events)""")
register("PRJ02_filled_ids", lambda s, d: made(s, d).agg(F.count_if(F.length("trace_id") == 32).alias("traces"), F.count_if(F.length("span_id") == 16).alias("spans")), "SELECT count(*) FILTER (event_id % 4 IN (1, 2) OR (event_id % 4 = 3 AND event_id % 5 IN (1, 3))) AS traces, count(*) AS spans FROM events")
register("ST08_late_trace_ids", lambda s, d: correlate.with_trace_ids(e(s, d).select(lit("").alias("trace_id"), text(ID).alias("span_id"), col("user_id").alias("pid"), lit("10.0.0.1").alias("source_ip"), lit(1).alias("source_port"), lit("10.0.0.2").alias("dest_ip"), lit(80).alias("dest_port"), col("ns").alias("start_ns"), col("event_type").alias("comm"))).select("span_id", "trace_id", "late"), "SELECT CAST(event_id AS VARCHAR) AS span_id, substr(sha256(concat_ws(':', user_id, '10.0.0.1', 1, '10.0.0.2', 80, epoch_us(ts) * 1000, event_type)), 1, 32) AS trace_id, true AS late FROM events")
register("SNK04_kept_rows", lambda s, d: tables.good(tables.clean(spans(s, d).withColumn("payload", lit("x" * 2000))))[0].select("trace_id", "span_id", "parent_span_id", F.length("payload").alias("n")),
         "SELECT lpad(CAST(o_orderkey AS VARCHAR), 32, '0') AS trace_id, lpad('1', 16, '0') AS span_id, NULL AS parent_span_id, 1024 AS n FROM orders UNION ALL SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0'), lpad(CAST(rn + 1 AS VARCHAR), 16, '0'), lpad(CAST((rn + 1) // 2 AS VARCHAR), 16, '0'), 1024 FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS rn FROM lineitem)")
register("SNK06_retention", lambda s, d: tables.retained(spans(s, d), 30, 883526400_000000).select("trace_id", "span_id"),
         "SELECT trace_id, span_id FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 32, '0') AS trace_id, lpad('1', 16, '0') AS span_id, o_orderdate AS t FROM orders UNION ALL SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0'), lpad(CAST(rn + 1 AS VARCHAR), 16, '0'), l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)) WHERE epoch_us(t) >= 883526400000000 - 30 * 86400000000")
