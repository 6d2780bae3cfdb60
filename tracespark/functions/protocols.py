"""Payloads to protocol messages. Framing with fixed places is read with SQL functions; formats that
need a loop over bytes (RESP, header blocks, chains of proxy messages) use Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import integer
from .scalars import bound, last_wins, once, truncated

METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE")
# What the first four bytes of an HTTP message may be.
HTTP_STARTS = ("GET ", "POST", "PUT ", "DELE", "PATC", "HEAD", "OPTI", "CONN", "TRAC", "HTTP")
REQUEST = rf"^({'|'.join(METHODS)})\s+(\S+)\s+HTTP/(\d+\.\d+)"
RESPONSE = r"^HTTP/(\d+\.\d+)\s+(\d+)\s+(.+)"
# Ports that tell the protocol, in this order of precedence.
PORTS = {"http": (80, 8080, 3000, 8000, 9090), "grpc": (50051, 9000, 7000), "redis": (6379,)}
# The proxy framing.
MAGIC, HEADER, LONGEST = 0x454E5659, 28, 16 * 1024 * 1024
MESSAGE_TYPES = ("DATA", "HANDSHAKE", "ACK", "KEEPALIVE", "RESET")


def protocol_of_ports(dest: Column, source: Column, known: dict[str, tuple[int, ...]] = PORTS) -> Column:
    """FLT-07: host-order ports of either side; of several protocols the first one known."""
    out = F.lit("unknown")
    for name, ports in reversed(known.items()):
        out = F.when(dest.isin(*ports) | source.isin(*ports), name).otherwise(out)
    return out


def kernel_path(payload: Column) -> Column:
    """PP-26: the path of a GET, at most 255 bytes, up to a space or NUL."""
    return F.regexp_extract(text(payload), r"^GET ([^ \x00]{0,255})", 1)


def text(payload: Column) -> Column:
    return F.make_valid_utf8(payload.cast("string"))


# HTTP


def looks_http(payload: Column) -> Column:
    """PP-01."""
    return F.coalesce((F.length(payload) >= 4) & F.decode(F.substring(payload, 1, 4), "ISO-8859-1").isin(*HTTP_STARTS), F.lit(False))


def http_headers(message: Column) -> Column:
    """PP-04: a map of the header lines up to the first empty one; the last of equal names wins."""
    return bound(F.split(F.split(message, "\r\n\r\n", 2)[0], "\r\n"), header_lines)


def header_lines(lines: Column) -> Column:
    pairs = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda s: F.contains(s, F.lit(": "))), lambda s: F.struct(F.substring_index(s, ": ", 1).alias("k"), F.substring(s, F.instr(s, ": ") + 2, F.length(s)).alias("v")))
    return last_wins(pairs)


def context_header(headers: Column, name: str) -> Column:
    """PP-05: a header whatever its case, null without it."""
    return F.try_element_at(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


HTTP = ("is_request", "method", "path", "version", "status", "headers", "body", "trace_id", "span_id", "parent_span_id")


def http(payload: Column, fields: tuple[str, ...] = HTTP) -> Column:
    """PP-02 to PP-06: a struct of these fields, null where the payload is no HTTP message. Lines and headers are
    parted once, headers only where a field needs them."""

    def made(parts, lines, headers):
        first = lines[0]
        is_request = first.rlike(REQUEST)
        get = lambda pattern, i: F.regexp_extract(first, pattern, i)
        every = {
            "is_request": lambda: is_request,
            "method": lambda: F.when(is_request, get(REQUEST, 1)),
            "path": lambda: F.when(is_request, get(REQUEST, 2)),
            "version": lambda: F.when(is_request, get(REQUEST, 3)).otherwise(get(RESPONSE, 1)),
            "status": lambda: F.when(first.rlike(RESPONSE), get(RESPONSE, 2).try_cast("int")),
            "headers": lambda: headers,
            "body": lambda: F.when((F.size(parts) > 1) & (parts[1] != ""), parts[1]),
            "trace_id": lambda: context_header(headers, "x-trace-id"),
            "span_id": lambda: context_header(headers, "x-span-id"),
            "parent_span_id": lambda: context_header(headers, "x-parent-span-id"),
        }
        return F.struct(*[every[f]().alias(f) for f in fields])

    def parted(parts, lines):
        found = bound(header_lines(lines), lambda headers: made(parts, lines, headers)) if {"headers", "trace_id", "span_id", "parent_span_id"} & set(fields) else made(parts, lines, None)
        return F.when(lines[0].rlike(REQUEST) | lines[0].rlike(RESPONSE), found)

    message = F.split(text(payload), "\r\n\r\n", 2)
    return F.when(looks_http(payload), bound(message, lambda parts: bound(F.split(parts[0], "\r\n"), lambda lines: parted(parts, lines))))


# gRPC

GRPC = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("service", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
    ]
)


def looks_grpc(payload: Column) -> Column:
    """PP-08."""
    return F.coalesce((F.length(payload) >= 5) & F.hex(F.substring(payload, 1, 1)).isin("00", "01"), F.lit(False))


def parse_grpc(payload: bytes | None, compat: bool = False) -> dict | None:
    """PP-09, PP-10. The status is the compressed flag. With compat the path found outside the header
    block is parted at its leading slash too, which leaves the service empty."""
    if payload is None or len(payload) < 5 or payload[0] > 1:
        return None
    out = dict(status=payload[0], service="", method="", metadata={}, trace_id=None, span_id=None, parent_span_id=None)
    body = payload[5:]
    if len(body) >= 5 and body[0] == 0:
        size = int.from_bytes(body[1:5], "big")
        for line in body[5 : 5 + size].decode("utf-8", "replace").split("\r\n") if size <= len(body) - 5 else ():
            if not line:
                break
            at = line.find(":", 0 if compat else 1)
            if at < 0:
                continue
            key, value = line[:at].strip(), line[at + 1 :].strip()
            out["metadata"][key] = value
            low = key.lower()
            if low in ("x-trace-id", "x-span-id", "x-parent-span-id"):
                out[low[2:].replace("-", "_")] = value
            elif low == ":path" and len(parts := value.split("/")) >= 3:
                out["service"], out["method"] = parts[1], parts[2]
    if (not out["service"] or compat) and (slash := payload.find(b"/")) > 0:
        start = payload.rfind(b"\0", 0, slash) + 1
        end = payload.find(b"\0\0\0", start)
        if end > start:
            path = payload[start:end].decode("utf-8", "replace")
            parts = (path if compat else path.lstrip("/")).split("/")
            if len(parts) >= (3 if compat else 2):
                out["service"], out["method"] = parts[0], parts[1]
    return out


def _structs(made: list, schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: [None if m is None else m[f.name] for m in made] for f in schema}, dtype=object)


def grpc(payload: Column, compat: bool = False) -> Column:
    @F.pandas_udf(GRPC)
    def run(payloads: pd.Series) -> pd.DataFrame:
        return _structs([None if p is None else parse_grpc(p, compat) for p in payloads], GRPC)

    # A function in Python is given every row, so it is given null where there is nothing to parse; it is
    # nondeterministic, so that it isn't run again for each use.
    return F.when(looks_grpc(payload), run.asNondeterministic()(F.when(looks_grpc(payload), payload)))


# Redis

COMMAND = T.StructType([T.StructField("command", T.StringType()), T.StructField("key", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("is_response", T.BooleanType())])


def looks_redis(payload: Column) -> Column:
    """PP-12."""
    return F.coalesce(F.decode(F.substring(payload, 1, 1), "ISO-8859-1").rlike(r"^[*+:$A-Z-]"), F.lit(False))


def _command(words: list[str], response: bool = False) -> dict:
    return dict(command=words[0].upper() if words else "", key=words[1] if len(words) > 1 else "", args=words[2:], is_response=response)


def _number(b: bytes) -> int | None:
    try:
        return int(b)
    except ValueError:
        return None


def _array(p: bytes, at: int) -> tuple[dict, int] | None:
    """PP-14: *N and then N bulk strings; what is missing at the end is left out."""
    end = p.find(b"\r\n", at)
    count = _number(p[at + 1 : end]) if end >= 0 else None
    if count is None or count <= 0:
        return None
    words, pos = [], end + 2
    while len(words) < count and pos < len(p) and p[pos : pos + 1] == b"$":
        end = p.find(b"\r\n", pos)
        size = _number(p[pos + 1 : end]) if end >= 0 else None
        if size is None or size < 0:
            break
        pos = end + 2
        if pos + size > len(p):
            break
        words.append(p[pos : pos + size].decode("utf-8", "replace"))
        pos += size + 2
    return _command(words), pos


def _reply(p: bytes, at: int) -> tuple[dict, int]:
    """PP-15: the kind of reply as command, its text as key, a bulk string as argument."""
    end = p.find(b"\r\n", at)
    end = len(p) if end < 0 else end
    out = dict(command=chr(p[at]), key=p[at + 1 : end].decode("utf-8", "replace"), args=[], is_response=True)
    pos = end + 2
    if p[at : at + 1] == b"$":
        size = _number(p[at + 1 : end])
        if size and size > 0 and pos + size <= len(p):
            out["args"] = [p[pos : pos + size].decode("utf-8", "replace")]
            pos += size + 2
    return out, pos


def _inline(p: bytes, at: int) -> tuple[dict, int]:
    """PP-16: words up to the end of the line."""
    end = p.find(b"\n", at)
    end = len(p) if end < 0 else end
    return _command(p[at:end].decode("utf-8", "replace").split()), end + 1


def parse_redis(payload: bytes | None) -> list[dict] | None:
    """PP-13: all commands of a payload; what can't be read ends the list, null if it is the first."""
    if not payload:
        return None
    out, at = [], 0
    while at < len(payload):
        first = payload[at : at + 1]
        got = _array(payload, at) if first == b"*" else _reply(payload, at) if first in b"+-:$" else _inline(payload, at) if b"A" <= first <= b"Z" else None
        if got is None:
            break
        out.append(got[0])
        at = got[1]
    return out or None


@F.pandas_udf(T.ArrayType(COMMAND))
def _redis(payloads: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else parse_redis(p) for p in payloads], dtype=object)


def redis(payload: Column) -> Column:
    """PP-13 to PP-16: an array of commands, null where there is none."""
    return F.when(looks_redis(payload), _redis.asNondeterministic()(F.when(looks_redis(payload), payload)))


def redis_tags(commands: Column) -> Column:
    """PP-17, AGG-16: the number of commands, whether it is a pipeline, the keys."""
    keys = F.filter(F.transform(commands, lambda c: c["key"]), lambda k: k != "")
    return F.struct(F.size(commands).alias("redis_command_count"), (F.size(commands) > 1).alias("redis_pipeline"), keys.alias("redis_keys"))


# The proxy framing


def looks_framed(payload: Column) -> Column:
    """PP-18: the framing that can be parsed at all: whole header, magic number, bounded length."""
    return F.coalesce((F.length(payload) >= HEADER) & (integer(payload, 0, 4, big=True) == MAGIC) & (integer(payload, 16, 4, big=True) <= LONGEST), F.lit(False))


def unframed(payload: Column) -> Column:
    """PP-25: what the frame holds, or the payload itself."""
    return F.when(looks_framed(payload), F.substring(payload, F.lit(HEADER + 1), integer(payload, 16, 4, big=True).cast("int"))).otherwise(payload)


def message_type(code: Column) -> Column:
    """PP-23."""
    return F.coalesce(F.get(F.array(*map(F.lit, MESSAGE_TYPES)), code.cast("int") - 1), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def inner_protocol(inner: Column) -> Column:
    """PP-21: by the first bytes."""
    start = lambda n: F.decode(F.substring(inner, 1, n), "ISO-8859-1")
    byte = lambda i: integer(inner, i, 1)
    n = F.length(inner)
    framed = F.when(n > 8, byte(3).isin(0, 1) & integer(inner, 1, 4, big=True).between(1, 1024 * 1024 - 1))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "")
        .when((n > 4) & start(4).isin("GET ", "POST", "HTTP"), "http")
        .when((n > 5) & (start(3) == "PRI"), "redis")
        .when(framed, "grpc")
        .when((n > 2) & byte(0).isin(1, 2) & byte(1).isin(1, 2), "mysql")
        .otherwise("unknown")
    )


def framed(payload: Column) -> Column:
    """PP-19 to PP-23: the frame's header and what it says of its content, null without a frame."""
    inner = unframed(payload)
    kind, flags = integer(payload, 5, 1), integer(payload, 6, 1)
    bit = lambda b: flags.bitwiseAND(F.lit(b).cast("long")) != 0
    start = F.decode(F.substring(inner, 1, 4), "ISO-8859-1")
    is_request = F.when(bit(2), False).when((F.length(inner) > 4) & (start.rlike("^(GET|PUT|DEL)") | (start == "POST")), True).when((F.length(inner) > 4) & (start == "HTTP"), False).otherwise(kind == 1)
    protocol = inner_protocol(inner)
    made = F.struct(
        integer(payload, 4, 1).alias("version"),
        message_type(kind).alias("type"),
        flags.alias("flags"),
        F.conv(F.hex(F.substring(payload, 9, 8)), 16, 10).cast("decimal(20,0)").alias("stream_id"),
        integer(payload, 16, 4, big=True).alias("length"),
        F.conv(F.hex(F.substring(payload, 21, 8)), 16, 10).cast("decimal(20,0)").alias("timestamp"),
        inner.alias("inner"),
        protocol.alias("protocol"),
        is_request.alias("is_request"),
        bit(1).alias("is_udp"),
        F.concat(F.lit("ENVOY_"), message_type(kind), F.lit("_"), F.upper(protocol)).alias("operation"),
    )
    return F.when(looks_framed(payload), made)


def split_frames(payload: bytes | None) -> list[bytes]:
    """PP-24: the whole frames at the start of a payload."""
    out, at = [], 0
    while payload is not None and len(payload) - at >= HEADER:
        size = int.from_bytes(payload[at + 16 : at + 20], "big")
        if int.from_bytes(payload[at : at + 4], "big") != MAGIC or size > LONGEST or at + HEADER + size > len(payload):
            break
        out.append(payload[at : at + HEADER + size])
        at += HEADER + size
    return out


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _frames(payloads: pd.Series) -> pd.Series:
    return pd.Series([split_frames(p) for p in payloads], dtype=object)


def frames(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """PP-24: a row for each frame of a payload, with its number and what `framed` tells."""
    return df.select(*[c for c in df.columns if c != payload_col], F.posexplode(_frames(payload_col)).alias("frame", "message")).withColumn("framed", framed(F.col("message")))


# All together


def parse(df: DataFrame, payload_col: str = "payload", protocol_col: str = "protocol", compat: bool = False) -> DataFrame:
    """PP-00, PP-07, PP-11: unwraps a frame, parses by protocol, and sets operation, error_code, path,
    trace context and tags; an empty payload leaves them null."""
    p = F.col("__p")
    opened = once(df, framed=framed(F.col(payload_col)))
    opened = once(opened, __p=F.when(F.length(payload_col) > 0, F.coalesce(F.when(F.length("framed.inner") > 0, F.col("framed.inner")), F.col(payload_col))))
    is_ = lambda name: F.col(protocol_col) == name
    parsed = once(opened, http=F.when(is_("http"), http(p))).withColumns({"grpc": grpc(F.when(is_("grpc"), p), compat), "redis": redis(F.when(is_("redis"), p))})
    first = F.get("redis", F.lit(0))
    operation = (
        F.when(F.col("http.is_request"), F.concat_ws(" ", "http.method", "http.path"))
        .when(F.col("grpc").isNotNull(), F.concat_ws("/", "grpc.service", "grpc.method"))
        .when(first.isNotNull(), F.concat_ws(" ", first["command"], first["key"]))
        .otherwise(F.col("framed.operation"))
    )
    context = {c: F.coalesce(F.col(f"http.{c}"), F.col(f"grpc.{c}")) for c in ("trace_id", "span_id", "parent_span_id")}
    return parsed.withColumns(
        {
            "parsed_operation": operation,
            "parsed_error_code": F.coalesce(F.col("http.status"), F.col("grpc.status")),
            "parsed_path": F.col("http.path"),
            **{f"parsed_{c}": v for c, v in context.items()},
            "redis_tags": F.when(F.col("redis").isNotNull(), redis_tags(F.col("redis"))),
            "raw": truncated(text(p)),
        }
    ).drop("__p")


def info_json(df: DataFrame) -> DataFrame:
    """S-21: what parse() found as JSON."""
    return df.withColumn("info", F.to_json(F.struct("http", "grpc", "redis", F.col("framed").dropFields("inner").alias("framed"), "raw")))
