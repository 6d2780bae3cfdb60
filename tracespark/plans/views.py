"""Spans, latency samples and connection events over the star-schema test tables, for Spark and
(as common table expressions) for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folds import spread, tasks_of

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(t: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp, with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), t.cast("timestamp_ntz")) * 1000


def timed(df: DataFrame) -> DataFrame:
    """start_time as a timestamp, with start_ns, end_ns and end_time beside it."""
    return (
        df.withColumn("start_ns", nanos(F.col("start_time")))
        .withColumn("end_ns", F.col("start_ns") + F.floor(F.col("duration_ms") * 1000).cast("long") * 1000)
        .withColumn("start_time", F.timestamp_micros(F.expr("start_ns div 1000")))
        .withColumn("end_time", F.timestamp_micros(F.expr("end_ns div 1000")))
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each order: its root, and a span for each line in a heap-shaped tree."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    orders = table(spark, sf_dir, "orders").select(
        pad(F.col("o_orderkey"), 32).alias("trace_id"),
        F.lit("1".rjust(16, "0")).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.lit("gateway").alias("service_name"),
        F.col("o_orderpriority").alias("operation"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_totalprice") / 1000).alias("duration_ms"),
        F.when(F.col("o_orderstatus") == "P", 500).otherwise(200).alias("error_code"),
        F.lit("http").alias("protocol"),
        F.lit(0).cast("long").alias("payload_size"),
    )
    lineitem = table(spark, sf_dir, "lineitem")
    numbered = spread(lineitem, tasks_of(lineitem), "l_orderkey").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    lines = numbered.select(
        pad(F.col("l_orderkey"), 32).alias("trace_id"),
        pad(F.col("rn") + 1, 16).alias("span_id"),
        pad(F.expr("(rn + 1) div 2"), 16).alias("parent_span_id"),
        F.concat(F.lit("svc-"), "l_returnflag").alias("service_name"),
        F.col("l_linestatus").alias("operation"),
        F.col("l_shipdate").alias("start_time"),
        (F.col("l_quantity") * 20).alias("duration_ms"),
        F.when(F.col("l_discount") >= 0.09, 503).otherwise(0).alias("error_code"),
        F.when(F.col("l_linenumber") % 3 == 0, "grpc").when(F.col("l_linenumber") % 3 == 1, "http").otherwise("redis").alias("protocol"),
        F.floor("l_extendedprice").cast("long").alias("payload_size"),
    )
    return timed(orders.unionByName(lines))


SPANS_SQL = f"""
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
spans AS MATERIALIZED (
  SELECT *, epoch_us(start_time) AS start_us, epoch_us(start_time) + CAST(floor(duration_ms * 1000) AS BIGINT) AS end_us FROM (
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 32, '0') AS trace_id, lpad('1', 16, '0') AS span_id, '' AS parent_span_id, 'gateway' AS service_name,
           o_orderpriority AS operation, o_orderdate AS start_time, o_totalprice / 1000 AS duration_ms,
           CASE o_orderstatus WHEN 'P' THEN 500 ELSE 200 END AS error_code, 'http' AS protocol, CAST(0 AS BIGINT) AS payload_size
    FROM orders
    UNION ALL
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0'), lpad(CAST(rn + 1 AS VARCHAR), 16, '0'), lpad(CAST((rn + 1) // 2 AS VARCHAR), 16, '0'), 'svc-' || l_returnflag,
           l_linestatus, l_shipdate, l_quantity * 20, CASE WHEN l_discount >= 0.09 THEN 503 ELSE 0 END,
           CASE l_linenumber % 3 WHEN 0 THEN 'grpc' WHEN 1 THEN 'http' ELSE 'redis' END, CAST(floor(l_extendedprice) AS BIGINT)
    FROM numbered
  )
)"""


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each row of events, for folds over time."""
    return timed(
        table(spark, sf_dir, "events").select(
            F.lpad(F.col("user_id").cast("string"), 32, "0").alias("trace_id"),
            F.lpad(F.col("event_id").cast("string"), 16, "0").alias("span_id"),
            F.lit("").alias("parent_span_id"),
            F.lit("user-svc").alias("service_name"),
            F.col("event_type").alias("operation"),
            F.lit("http").alias("protocol"),
            F.col("ts").alias("start_time"),
            F.col("value").alias("duration_ms"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("error_code"),
            F.lit(0).cast("long").alias("payload_size"),
        )
    )


LATENCIES_SQL = """
latencies AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(event_id AS VARCHAR), 16, '0') AS span_id, '' AS parent_span_id, 'user-svc' AS service_name,
         event_type AS operation, 'http' AS protocol, ts AS start_time, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) AS end_us,
         value AS duration_ms, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS error_code, CAST(0 AS BIGINT) AS payload_size
  FROM events
)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket events of one connection per user: open, request, response, close."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "purchase", "response").otherwise("close")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("conn_key"),
        kind.alias("kind"),
        nanos(F.col("ts")).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.lpad(F.col("event_id").cast("string"), 16, "0").alias("span_id"),
        F.sha2(F.concat(F.lit("t"), F.col("event_id").cast("string")), 256).substr(1, 32).alias("trace_id"),
    )


CONNECTIONS_SQL = """
connections AS (
  SELECT CAST(user_id AS VARCHAR) AS conn_key,
         CASE WHEN event_type = 'signup' THEN 'open' WHEN event_type IN ('view', 'click') THEN 'request' WHEN event_type = 'purchase' THEN 'response' ELSE 'close' END AS kind,
         epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, lpad(CAST(event_id AS VARCHAR), 16, '0') AS span_id, substr(sha256('t' || CAST(event_id AS VARCHAR)), 1, 32) AS trace_id
  FROM events
)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records (event_id, record) made from events: the layout of RAW_LAYOUT, with an HTTP request
    as payload."""
    from ..functions.codec import encode

    e = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)  # small files, wide records
    request = F.concat(F.lit("GET /"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\r\nx-trace-id: t"), F.col("user_id").cast("string"), F.lit("\r\n\r\n"))
    return e.select(
        "event_id",
        encode(
            timestamp=nanos(F.col("ts")),
            pid=F.col("user_id"),
            tid=F.col("event_id") % 100000,
            uid=F.lit(1000),
            gid=F.lit(1000),
            comm=F.col("event_type"),
            event_type=F.col("event_id") % 5,
            protocol=F.col("event_id") % 4,
            saddr=F.lit(0x0100007F) + F.col("event_id") % 100 * 0x1000000,
            daddr=F.lit(0x0200007F),
            sport=F.col("event_id") % 60000 + 1,
            dport=F.lit(0x901F),
            duration_ns=F.floor(F.col("value") * 1000000).cast("long"),
            error_code=F.when(F.col("event_type") == "error", -111).otherwise(200),
            payload_size=F.length(request),
            payload=request,
            trace_id=F.lit(""),
            span_id=F.lit(""),
            parent_span_id=F.lit(""),
            path=F.concat(F.lit("/"), "event_type"),
        ).alias("record"),
    )


def oracle(body: str, *views: str) -> str:
    """SQL with these views in front."""
    recursive = "RECURSIVE " if "UNION ALL" in body else ""
    return f"WITH {recursive}{', '.join(v.strip() for v in views)}{'' if body.lstrip().startswith(',') else ' '}{body}"
