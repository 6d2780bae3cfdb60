"""Raw socket events: capture files of fixed-size records, and their conversion to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode
from ..functions.protocols import PORTS, kernel_path, parse, protocol_of_ports
from ..functions.scalars import dotted, event_name, protocol_name, swapped_port
from ..operators.correlate import with_trace_ids
from ..schema import PAYLOAD_CHARS, RAW_SIZE, SPAN

FILE = "path string, modificationTime timestamp, length long, content binary"


def _records(files: DataFrame) -> DataFrame:
    """Records of capture files; a remainder shorter than a record is left out. Files are read whole by a
    task each, so writers should rotate them well under executor memory."""
    n = F.expr(f"int(length div {RAW_SIZE})")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    return files.select(F.col("path").alias("file"), "content", at.alias("record_nr")).select("file", "record_nr", F.substring("content", F.col("record_nr") * RAW_SIZE + 1, F.lit(RAW_SIZE)).alias("record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: all records under a path."""
    return _records(spark.read.format("binaryFile").load(path))


def stream_records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """SRC-10: records of files as they arrive; a slow reader holds the source back, nothing is dropped."""
    return _records(spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).load(path))


def events(records: DataFrame, record_col: str = "record", boot_epoch_ns: int = 0, ports: dict[str, tuple[int, ...]] = PORTS) -> DataFrame:
    """SRC-01 to SRC-09 as decoded rows: codes as names, addresses and ports in their usual form, times
    since 1970 (boot_epoch_ns: when the clock of the records was zero)."""
    e = decode(records, record_col)
    outgoing = ~F.col("event_type").isin(1, 3)  # accept and receive have the remote side as source
    sport, dport = F.col("sport").cast("int"), F.col("dport").cast("int")
    return (
        e.withColumns({"source_ip": dotted(F.col("saddr")), "dest_ip": dotted(F.col("daddr")), "source_port": F.when(outgoing, sport).otherwise(swapped_port(sport)), "dest_port": F.when(outgoing, swapped_port(dport)).otherwise(dport)})
        .withColumns({"event": event_name(F.col("event_type")), "start_ns": F.col("timestamp") + boot_epoch_ns, "protocol_code": F.col("protocol")})
        .withColumn("protocol", protocol_name(F.col("protocol_code")))
        .withColumn("protocol", F.when(F.col("protocol") == "unknown", protocol_of_ports(F.col("dest_port"), F.col("source_port"), ports)).otherwise(F.col("protocol")))
        .withColumn("failed_connect", (F.col("event_type") == 0) & (F.col("error_code") < 0))
        .withColumn("path", F.when(F.col("path") == "", kernel_path(F.col("payload"))).otherwise(F.col("path")))
    )


def spans(decoded: DataFrame, compat: bool = False) -> DataFrame:
    """PRJ-01, PRJ-02, PP-00: spans of the canonical schema, with what the payload tells."""
    e = decoded.withColumns({"service_name": F.col("comm"), "duration_ms": F.col("duration_ns") / 1e6, "end_ns": F.col("start_ns") + F.col("duration_ns")})
    p = parse(e, "payload", "protocol", compat)
    given = lambda c: F.coalesce(F.col(f"parsed_{c}"), F.when(F.col(c) != "", F.col(c)))
    side = F.when(F.coalesce(F.col("framed.is_udp"), F.lit(False)), "-sidecar").otherwise("")
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    tags = F.filter(
        F.array(
            tag("conn_age_ms", F.col("duration_ms")),
            tag("envoy_type", F.col("framed.type")),
            tag("envoy_stream_id", F.col("framed.stream_id")),
            tag("inner_protocol", F.col("framed.protocol")),
            tag("redis_command_count", F.col("redis_tags.redis_command_count")),
            tag("redis_pipeline", F.when(F.col("redis_tags.redis_pipeline"), "true")),
        ),
        lambda t: t["v"].isNotNull(),
    )
    made = p.withColumns(
        {
            **{c: given(c) for c in ("trace_id", "span_id", "parent_span_id")},
            "operation": F.coalesce("parsed_operation", F.col("event")),
            "error_code": F.coalesce("parsed_error_code", "error_code").cast("int"),
            "path": F.coalesce("parsed_path", F.when(F.col("path") != "", F.col("path"))),
            "service_name": F.concat("service_name", side),
            "event_type": F.col("event"),
            "payload": F.left(F.col("raw"), F.lit(PAYLOAD_CHARS)),
            "tags": F.map_from_entries(tags),
            "start_time": F.timestamp_micros(F.expr("start_ns div 1000")),
            "end_time": F.timestamp_micros(F.expr("end_ns div 1000")),
        }
    )
    return with_trace_ids(made.withColumn("timestamp", F.col("start_time"))).select(*[F.col(f.name).cast(f.dataType) for f in SPAN])
