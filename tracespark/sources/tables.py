"""Spans at rest: scans, partitioned writes, schema, retention; and their configuration."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protocols import PORTS
from ..functions.scalars import month, unpadded
from ..operators.anomaly import Detector
from ..operators.sampling import Rates
from ..schema import PAYLOAD_CHARS, SPAN, SPAN_ID_CHARS, TRACE_ID_CHARS
from . import upkeep


@dataclass
class Storage:
    dsn_host: str = "localhost"
    dsn_port: int = 9000
    database: str = "traces"
    user: str = "default"
    batch_size: int = 10_000
    flush_seconds: int = 5
    retries: int = 3
    span_days: int = 30
    rollup_days: int = 7

    def dsn(self) -> str:
        """S-28: where the spans are kept, as a connection string."""
        return f"tcp://{self.dsn_host}:{self.dsn_port}/{self.database}?username={self.user}"


@dataclass
class Sampling:
    threshold_ms: float = 500
    high: float = 1.0
    low: float = 0.01


@dataclass
class Anomaly:
    alpha: float = 0.2
    k: float = 3.0
    least: int = 100
    cooldown_s: float = 60


@dataclass
class Alerts:
    enabled: bool = False
    url: str = "http://localhost:9093"
    timeout_ms: int = 1000


@dataclass
class Protocols:
    """Ports that tell the protocol; none where one is not to be told."""

    http: list = field(default_factory=lambda: list(PORTS["http"]))
    grpc: list = field(default_factory=lambda: list(PORTS["grpc"]))
    redis: list = field(default_factory=lambda: list(PORTS["redis"]))


@dataclass
class Compression:
    enabled: bool = True
    level: int = 3
    similarity: float = 0.9


@dataclass
class Flamegraph:
    enabled: bool = True
    width: int = 1200
    row: int = 18
    deepest: int = 100


@dataclass
class Config:
    storage: Storage = field(default_factory=Storage)
    sampling: Sampling = field(default_factory=Sampling)
    anomaly: Anomaly = field(default_factory=Anomaly)
    alerts: Alerts = field(default_factory=Alerts)
    protocols: Protocols = field(default_factory=Protocols)
    compression: Compression = field(default_factory=Compression)
    flamegraph: Flamegraph = field(default_factory=Flamegraph)

    def rates(self) -> Rates:
        return Rates(self.sampling.threshold_ms, self.sampling.high, self.sampling.low)

    def detector(self) -> Detector:
        return Detector(self.anomaly.alpha, self.anomaly.k, self.anomaly.least, self.anomaly.cooldown_s)

    def ports(self) -> dict[str, tuple[int, ...]]:
        """For functions.protocols.protocol_of_ports."""
        return {name: tuple(ports) for name, ports in vars(self.protocols).items() if ports}


def as_kind(value, kind: type):
    """A value of a file or of the environment, where lists are joined by commas."""
    if kind is list:
        return [int(v) for v in (value.split(",") if isinstance(value, str) else value) if v != ""]
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return kind(value)


def load_config(path: str | None = None, prefix: str = "TRACESPARK") -> Config:
    """SRC-13: a YAML file; PREFIX_SECTION_NAME in the environment goes before it."""
    given = (yaml.safe_load(open(path)) or {}) if path else {}
    config = Config()
    for section in fields(config):
        part = getattr(config, section.name)
        for f in fields(part):
            value = os.environ.get(f"{prefix}_{section.name}_{f.name}".upper(), (given.get(section.name) or {}).get(f.name))
            if value is not None:
                setattr(part, f.name, as_kind(value, type(getattr(part, f.name))))
    return config


def clean(spans: DataFrame) -> DataFrame:
    """PRJ-03, PRJ-04: ids without padding and cut to their lengths, payloads cut, empty parents null."""
    cut = lambda c, n: F.left(unpadded(F.col(c)), F.lit(n))
    parent = cut("parent_span_id", SPAN_ID_CHARS)
    return spans.withColumns({"trace_id": cut("trace_id", TRACE_ID_CHARS), "span_id": cut("span_id", SPAN_ID_CHARS), "parent_span_id": F.when(parent != "", parent), "payload": F.left("payload", F.lit(PAYLOAD_CHARS))})


def is_good() -> Column:
    """Whether a row can be kept: it has both ids and a time."""
    return F.coalesce((F.col("trace_id") != "") & (F.col("span_id") != "") & F.col("start_time").isNotNull(), F.lit(False))


def good(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be kept, and the others."""
    ok = is_good()
    return spans.filter(ok), spans.filter(~ok)


def write_spans(spans: DataFrame, path: str, quarantine: str | None = None, batch: int | None = None) -> None:
    """SNK-04: Parquet by month and batch, in order of time and trace within a file, with a Bloom filter on the
    trace id; rows that can't be kept go to the quarantine. The rows of a numbered batch replace those
    that an earlier try at it has left; without a number each call has a folder of its own. upkeep.compact merges folders."""
    batch = upkeep.unnumbered() if batch is None else batch
    kept, bad = good(clean(spans))
    out = kept.withColumns({"timestamp": F.col("start_time"), "month": month(F.col("start_time")), "batch": F.lit(batch).cast("long")})
    (
        out.sortWithinPartitions("month", "start_time", "trace_id", "span_id")
        .write.mode("overwrite")
        .partitionBy("month", "batch")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .parquet(path)
    )
    if quarantine:
        bad.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(quarantine)


def read_spans(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC-12: the spans of a time range, with the month that they are kept under; months outside
    it aren't read, and operators with a time range of their own prune by it too. Folders that a compaction has merged
    are passed over."""
    found = upkeep.read_live(spark, path)
    for c, bound, keeps in (("start", start, lambda a, b: a >= b), ("end", end, lambda a, b: a <= b)):
        if bound is not None:
            t = F.lit(bound).cast("timestamp")
            found = found.filter(keeps(F.col("start_time"), t) & keeps(F.col("month").cast("string"), month(t)))
    return found.drop("batch")


def create_table(spark: SparkSession, name: str, location: str) -> None:
    """SNK-05."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPAN)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, month string, batch long) USING parquet PARTITIONED BY (month, batch) LOCATION '{location}'")


def retained(df: DataFrame, days: int, now_us: int | None = None, column: str = "start_time") -> DataFrame:
    """SNK-06: what a time to live of so many days leaves."""
    now = F.current_timestamp() if now_us is None else F.timestamp_micros(F.lit(now_us))
    return df.filter(F.col(column) >= now - F.make_dt_interval(days=F.lit(days)))


def with_retries(send: Callable[[], None], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> int:
    """SNK-03: up to so many repeats, 200, 400, 800 ms apart, 2 s longer when there are too many parts.
    Returns the repeats that it took."""
    for n in range(retries + 1):
        try:
            send()
            return n
        except Exception as e:
            if n == retries:
                raise
            wait(2 ** (n + 1) * 0.1 + (2.0 if "too many parts" in str(e).lower() else 0.0))
    return retries


def flush_seconds(rows: int) -> float:
    """SNK-04: how long a batch may take."""
    return min(max(rows / 1000, 10.0), 60.0)


def flush() -> None:
    """SNK-10: nothing waits in memory, so there is nothing to do."""
