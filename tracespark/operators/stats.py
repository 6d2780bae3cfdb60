"""Service statistics, the service map, and their rollups by the minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import materialise, spread, tasks_of
from .search import between_us, has_parent, is_error

MINUTE_US = 60_000_000
# What may be lost, wait, fail and be open before an alert or a warning.
EVENTS_DROPPED, QUEUE_FULL, FAILED_BATCHES, CONNECTIONS = 100, 0.8, 10, 500_000


def quantile(p: float, exact: bool = True, column: str = "duration_ms") -> Column:
    """Interpolated and exact by default. An exact percentile keeps the distinct values of a group;
    for groups of billions of different values use exact=False, a sketch of bounded size, or sorted_quantiles()."""
    return F.percentile(column, p) if exact else F.percentile_approx(column, p, 10_000).cast("double")


#: Size of a sketch of durations, a few kilobytes; up to so many values it is exact.
SKETCH = 800
SKETCHED = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def rank_error(k: int = SKETCH) -> float:
    """How far off the rank of a sketched quantile is, as a share of the values, in 99 of 100 cases (the published
    bound of KLL sketches). It doesn't grow with the number of values or merges."""
    return 2.296 / k**0.9723


def sketch(column: str = "duration_ms", k: int = SKETCH) -> Column:
    """The distribution of a column as a mergeable sketch of bounded size."""
    return F.kll_sketch_agg_double(column, k).alias("durations")


def sketched_quantiles(*quantiles: tuple[str, float], column: str = "durations") -> dict[str, Column]:
    """Columns for the quantiles of a sketch: values that occur, not interpolated."""
    return {f"{name}_duration_ms": F.kll_sketch_get_quantile_double(column, F.lit(p)) for name, p in quantiles}


def sorted_quantiles(rows: DataFrame, keys: list[str], *quantiles: tuple[str, float], column: str = "duration_ms", weight: str | None = None, interpolated: bool = True) -> DataFrame:
    """Exact quantiles of groups of any size, interpolated or the least value that so large a share of the group doesn't exceed:
    a row for each group with its keys, n (values that aren't null; groups without any have no row) and a column for
    each (name, share; to six places where not interpolated). weight: a column that says how often each row counts.

    Different values are counted first and range-sorted over all groups; sums of the sorted ranges tell at which
    rank of its group each range begins. So the values of a hot group are dealt over all tasks, and none are
    held in memory."""
    value, g = F.col(column).cast("double").alias("value"), F.struct(*[F.col(k) for k in keys]).alias("g")
    times = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("c")
    counted = rows.filter(F.col(column).isNotNull()).select(g, value, times).groupBy("g", "value").agg(F.sum("c").alias("c"))
    ranges = materialise(counted.repartitionByRange("g", "value").withColumn("part", F.spark_partition_id()))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranges.groupBy("g", "part").agg(F.sum("c").alias("s"), F.min("value").alias("least"))
    begins = sums.select("g", "part", (F.sum("s").over(so_far(Window.partitionBy("g").orderBy("least"))) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("g")).alias("n"))
    ranked = ranges.withColumn("own", F.sum("c").over(so_far(Window.partitionBy("g", "part").orderBy("value")))).join(begins, ["g", "part"])
    ranked = ranked.select("g", "n", "value", (F.col("before") + F.col("own") - F.col("c")).alias("first"), (F.col("before") + F.col("own")).alias("upto"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("value")))
    million = lambda p: F.col("n").cast("decimal(20,0)") * F.lit(round(p * 10**6))
    place = lambda p: (F.col("n") - 1) * F.lit(p) if interpolated else F.greatest(F.ceil(million(p) / 10**6).cast("long") - 1, F.lit(0))
    found = ranked.groupBy("g", "n").agg(*[at(side(place(p))).alias(f"{name}_{of}") for name, p in quantiles for of, side in (("low", F.floor), ("high", F.ceil))])
    low, high = (lambda name, of=of: F.col(f"{name}_{of}") for of in ("low", "high"))
    between = lambda name, p: F.when(low(name) == high(name), low(name)).otherwise(low(name) + (high(name) - low(name)) * (place(p) - F.floor(place(p))))
    return found.select("g.*", "n", *[between(name, p).alias(f"{name}_{column}") for name, p in quantiles])


def measures(*quantiles: tuple[str, float], exact: bool = True) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("call_count"),
        F.count_if(is_error()).alias("error_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        *[quantile(p, exact).alias(f"{name}_duration_ms") for name, p in quantiles],
    ]


def service_stats(spans: DataFrame, service: str | None, start_us: int | None, end_us: int | None, exact: bool | str = True) -> DataFrame:
    """AGG-01, SRT-04: the operations of a service in a time range. exact="sorted" takes the quantiles from
    sorted_quantiles(), for operations of billions of calls."""
    for c in between_us(start_us, end_us, spans.columns):
        spans = spans.filter(c)
    spans = spans.filter(F.col("service_name") == service) if service is not None else spans
    keys, quantiles = ["operation", "protocol"], (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    if exact == "sorted":
        told = sorted_quantiles(spans, keys, *quantiles).select(F.struct(*keys).alias("g"), *[f"{name}_duration_ms" for name, _ in quantiles])
        found = spans.groupBy(*keys).agg(*measures()).withColumn("g", F.struct(*keys)).join(told, "g", "left").drop("g")
    else:
        found = spans.groupBy(*keys).agg(*measures(*quantiles, exact=exact))
    return found.orderBy(F.desc("call_count"), *keys)


def calls(spans: DataFrame, start_us: int | None = None, end_us: int | None = None, longest_us: int | None = None) -> DataFrame:
    """JN-01: every child span that starts in the range with the service of its parent. The child side is
    filtered before the shuffle; both sides carry only what the edge needs. Parents may start at any
    time; with longest_us, a bound on how far apart spans of one trace start, they are only read that
    far around the range."""
    child = spans.filter(has_parent())
    for c in between_us(start_us, end_us, spans.columns):
        child = child.filter(c)
    child = child.select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("service_name").alias("source_service"), "protocol", "duration_ms", "error_code", "start_time", "start_ns")
    if longest_us is not None:
        for c in between_us(None if start_us is None else start_us - longest_us, None if end_us is None else end_us + longest_us, spans.columns):
            spans = spans.filter(c)
    parent = spans.select("trace_id", "span_id", F.col("service_name").alias("dest_service"))
    n, keys = tasks_of(parent), ["trace_id", "span_id"]
    return spread(child, n, *keys).join(spread(parent, n, *keys), keys)


def service_map(spans: DataFrame, start_us: int | None, end_us: int | None, longest_us: int | None = None) -> DataFrame:
    """AGG-02. source_service is the called side and dest_service the calling side; callee and
    caller name the same columns by their role."""
    edges = calls(spans, start_us, end_us, longest_us)
    found = edges.groupBy("source_service", "dest_service", "protocol").agg(*measures())
    return found.withColumns({"callee": F.col("source_service"), "caller": F.col("dest_service")})


def minute_of(column: str = "start_ns") -> Column:
    us = F.expr(f"{column} div 1000")
    return (us - F.pmod(us, F.lit(MINUTE_US))).alias("minute_us")


def stats_rollup(spans: DataFrame, exact: bool = True) -> DataFrame:
    """AGG-03: a row for each minute, service, operation and protocol; sums beside the averages, so
    that rows can be merged."""
    return spans.groupBy(minute_of(), "service_name", "operation", "protocol").agg(
        *measures(("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), exact=exact),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.sum("payload_size").alias("total_payload_size"),
        F.sum("duration_ms").alias("sum_duration_ms"),
    )


def sketched_rollup(spans: DataFrame, k: int = SKETCH) -> DataFrame:
    """AGG-03 with durations, a sketch from which merged_stats takes the quantiles of longer periods."""
    found = spans.groupBy(minute_of(), "service_name", "operation", "protocol").agg(*measures(), F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms"), F.sum("payload_size").alias("total_payload_size"), F.sum("duration_ms").alias("sum_duration_ms"), sketch(k=k))
    return found.withColumns(sketched_quantiles(*SKETCHED))


PERIOD = ("period_us", "service_name", "operation", "protocol")


def counted_rollup(spans: DataFrame, every_us: int = MINUTE_US) -> DataFrame:
    """How often each duration occurs in each period of a service, operation and protocol (calls; null durations too): what merges
    to the exact quantiles of any longer period, at the size of the different values."""
    us = F.expr("start_ns div 1000")
    return spans.groupBy((us - F.pmod(us, F.lit(every_us))).alias("period_us"), *PERIOD[1:], "duration_ms").agg(F.count(F.lit(1)).alias("calls"))


def merged_counts(parts: DataFrame, every_us: int = 60 * MINUTE_US) -> DataFrame:
    """Rows of counted_rollup, or of periods merged before, as longer periods."""
    return parts.groupBy((F.col("period_us") - F.pmod("period_us", F.lit(every_us))).alias("period_us"), *PERIOD[1:], "duration_ms").agg(F.sum("calls").alias("calls"))


def counted_quantiles(parts: DataFrame, *quantiles: tuple[str, float]) -> DataFrame:
    """AGG-06: call_count and the exact quantiles (values that occur) of the periods of counted_rollup or merged_counts, null
    where no call has a duration. No group meets in one task."""
    keys = list(PERIOD)
    g = F.struct(*keys).alias("g")
    told = sorted_quantiles(parts, keys, *quantiles, weight="calls", interpolated=False).select(g, *[f"{name}_duration_ms" for name, _ in quantiles])
    return parts.groupBy(*keys).agg(F.sum("calls").alias("call_count")).withColumn("g", g).join(told, "g", "left").drop("g")


def map_rollup(spans: DataFrame, exact: bool = True) -> DataFrame:
    """AGG-04: a row for each minute and edge."""
    return rollup_of_calls(calls(spans), exact)


def rollup_of_calls(edges: DataFrame, exact: bool = True) -> DataFrame:
    return edges.groupBy(minute_of(), "source_service", "dest_service", "protocol").agg(*measures(("p95", 0.95), ("p99", 0.99), exact=exact), F.sum("duration_ms").alias("sum_duration_ms"))


def merged_map(parts: DataFrame) -> DataFrame:
    """AGG-05: rows of equal key from several rollups as one; averages come from the sums."""
    keys = ["minute_us", "source_service", "dest_service", "protocol"]
    return parts.groupBy(*keys).agg(F.sum("call_count").alias("call_count"), F.sum("error_count").alias("error_count"), F.sum("sum_duration_ms").alias("sum_duration_ms")).withColumn("avg_duration_ms", F.col("sum_duration_ms") / F.col("call_count"))


def merged_stats(parts: DataFrame, every_us: int = 60 * MINUTE_US, k: int = SKETCH) -> DataFrame:
    """AGG-06: minutes, or periods merged before, as longer periods. Parts with a column durations (sketched_rollup) keep it,
    merged, and have quantiles within rank_error(k), however often they are merged; without one there are none."""
    start = "period_us" if "period_us" in parts.columns else "minute_us"
    bucket = (F.col(start) - F.pmod(start, F.lit(every_us))).alias("period_us")
    durations = [F.kll_merge_agg_double("durations", k).alias("durations")] if "durations" in parts.columns else []
    total = F.sum("sum_duration_ms") if "sum_duration_ms" in parts.columns else F.sum(F.col("avg_duration_ms") * F.col("call_count"))
    found = parts.groupBy(bucket, "service_name", "operation", "protocol").agg(
        F.sum("call_count").alias("call_count"),
        F.sum("error_count").alias("error_count"),
        (total / F.sum("call_count")).alias("avg_duration_ms"),
        F.min("min_duration_ms").alias("min_duration_ms"),
        F.max("max_duration_ms").alias("max_duration_ms"),
        F.sum("total_payload_size").alias("total_payload_size"),
        *durations,
    )
    return found.withColumns(sketched_quantiles(*SKETCHED)) if durations else found


def alerts(c: dict) -> dict:
    """AGG-14: what of the counters, as numbers or columns, raises an alert or a warning."""
    return {
        "event_alert": c["events_dropped"] > EVENTS_DROPPED,
        "queue_alert": c["queue_size"] > c["queue_capacity"] * QUEUE_FULL,
        "batch_alert": c["failed_batches"] > FAILED_BATCHES,
        "connection_warning": c["connections"] > CONNECTIONS,
    }


def drop_rates(counters: DataFrame) -> DataFrame:
    """AGG-14: events and spans lost and the queue's filling in percent, 0 where there was nothing, and what
    of it raises an alert or a warning. A queue of the source holds what isn't read yet."""
    percent = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    return counters.select(
        "*",
        percent("events_dropped", "events_total").alias("event_drop_rate"),
        percent("spans_dropped", "spans_total").alias("span_drop_rate"),
        percent("queue_size", "queue_capacity").alias("queue_usage_percent"),
        *[so.alias(name) for name, so in alerts({c: F.col(c) for c in counters.columns}).items()],
    )
