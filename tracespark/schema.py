"""Schemas: the raw event record, spans, rollups, and the codes that records carry."""

from __future__ import annotations

from pyspark.sql import types as T

# Event and protocol codes of raw records. Code 3 of the protocol is "unknown" in the
# record; the proxy framing is recognised by its magic number alone.
EVENT_TYPES = ("connect", "accept", "send", "recv", "close")
PROTOCOLS = ("http", "grpc", "redis")

# Name, offset, size and kind of each field of a raw record (C layout, little endian).
RAW_LAYOUT = (
    ("timestamp", 0, 8, "int"),
    ("pid", 8, 4, "int"),
    ("tid", 12, 4, "int"),
    ("uid", 16, 4, "int"),
    ("gid", 20, 4, "int"),
    ("comm", 24, 16, "text"),
    ("event_type", 40, 1, "int"),
    ("protocol", 41, 1, "int"),
    ("saddr", 44, 4, "int"),
    ("daddr", 48, 4, "int"),
    ("sport", 52, 2, "int"),
    ("dport", 54, 2, "int"),
    ("duration_ns", 56, 8, "int"),
    ("error_code", 64, 4, "signed"),
    ("payload_size", 68, 4, "int"),
    ("payload", 72, 1024, "bytes"),
    ("trace_id", 1096, 33, "text"),
    ("span_id", 1129, 17, "text"),
    ("parent_span_id", 1146, 17, "text"),
    ("path", 1163, 256, "text"),
)
RAW_SIZE = 1424
PAYLOAD_MOST = 1024

SPAN = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("payload_size", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("dest_port", T.IntegerType()),
        T.StructField("pid", T.LongType()),
        T.StructField("comm", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Lengths that ids and payloads are cut to at rest.
TRACE_ID_CHARS, SPAN_ID_CHARS, PAYLOAD_CHARS = 32, 16, 1024
ERROR_FROM = 400
