"""Trace search: optional filters, pages of trace ids, whole traces."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month
from ..schema import ERROR_FROM

#: FLT-09 and FLT-10: what a request without these gets.
PAGE, SEARCH_BACK, STATS_BACK = 20, timedelta(hours=24), timedelta(hours=1)


@dataclass(frozen=True)
class TraceQuery:
    """A conjunction of the conditions that are set; times are inclusive, in microseconds."""

    service: str | None = None
    start_us: int | None = None
    end_us: int | None = None
    least_ms: float | None = None
    most_ms: float | None = None
    protocol: str | None = None
    trace_id: str | None = None
    limit: int = 0
    offset: int = 0

    def with_defaults(self, now: datetime | None = None) -> TraceQuery:
        """FLT-09: the last 24 hours, a page of 20; bounds of zero are no bounds."""
        now = now or datetime.now(timezone.utc)
        us = lambda t: int(t.timestamp() * 1_000_000)
        return TraceQuery(
            self.service or None,
            self.start_us or us(now - SEARCH_BACK),
            self.end_us or us(now),
            self.least_ms or None,
            self.most_ms or None,
            self.protocol or None,
            self.trace_id or None,
            self.limit if self.limit > 0 else PAGE,
            max(self.offset, 0),
        )


def is_error(df: DataFrame | None = None) -> Column:
    """FLT-03."""
    return F.col("error_code") >= ERROR_FROM


def has_parent(column: str = "parent_span_id") -> Column:
    """FLT-04."""
    return F.coalesce(F.col(column), F.lit("")) != ""


def between_us(start_us: int | None, end_us: int | None, columns: list[str] = ()) -> list[Column]:
    """FLT-02, with predicates on start_time itself so that they reach the scan; where `columns` has the month
    that SNK-04 partitions by, also on that, so that other months aren't listed or read."""
    out = []
    for us, keeps in ((start_us, operator.ge), (end_us, operator.le)):
        if us is not None:
            t = F.timestamp_micros(F.lit(us))
            out.append(keeps(F.col("start_time"), t))
            if "month" in columns:
                out.append(keeps(F.col("month").cast("string"), month(t)))
    return out


def conditions(q: TraceQuery, columns: list[str] = ()) -> list[Column]:
    """FLT-01."""
    out = between_us(q.start_us, q.end_us, columns)
    for column, value in (("service_name", q.service), ("protocol", q.protocol), ("trace_id", q.trace_id)):
        if value is not None:
            out.append(F.col(column) == value)
    if q.least_ms is not None:
        out.append(F.col("duration_ms") >= q.least_ms)
    if q.most_ms is not None:
        out.append(F.col("duration_ms") <= q.most_ms)
    return out


def matching(spans: DataFrame, q: TraceQuery) -> DataFrame:
    found = conditions(q, spans.columns)
    return spans.filter(functools.reduce(operator.and_, found)) if found else spans


def trace_ids(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """AGG-08, SRT-02, LIM-01, LIM-02: ids of matching traces, latest first, one page."""
    ids = matching(spans, q).groupBy("trace_id").agg(F.max("start_ns").alias("last_ns")).orderBy(F.desc("last_ns"), "trace_id")
    ids = ids.offset(q.offset) if q.offset > 0 else ids
    return ids.limit(q.limit) if q.limit > 0 else ids


def search(spans: DataFrame, q: TraceQuery) -> DataFrame:
    """TR-02, JN-03: all spans of a page of traces, in one join. A page of bounded size is
    broadcast; without a limit the join is left to the planner."""
    ids = trace_ids(spans, q).select("trace_id")
    ids = F.broadcast(ids) if 0 < q.limit <= 10_000 else ids
    return spans.join(ids, "trace_id", "left_semi").drop("month").orderBy("trace_id", "start_ns", "span_id")


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """TR-01, SRT-01: a trace's spans in order."""
    return spans.filter(F.col("trace_id") == trace_id).drop("month").orderBy("start_ns", "span_id")


def services(spans: DataFrame) -> DataFrame:
    """AGG-07, SRT-03, SET-01."""
    return spans.select("service_name").distinct().orderBy("service_name")


def service_count(spans: DataFrame) -> DataFrame:
    """AGG-10."""
    return spans.agg(F.countDistinct("service_name").alias("services"))


def envelopes(spans: DataFrame) -> DataFrame:
    """AGG-09: start, end and duration of each trace."""
    found = spans.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("spans"))
    return found.withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6)
