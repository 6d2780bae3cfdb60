"""Sampling of spans and whole traces. Draws are digests of the trace id, so that retries, reruns and
all spans of a trace agree."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ERROR_FROM
from .folds import spread, tasks_of


@dataclass(frozen=True)
class Rates:
    """SMP-01's parameters; SMP-03: a change of configuration is another value."""

    threshold_ms: float = 500
    high: float = 1.0
    low: float = 0.01

    def updated(self, **changes) -> Rates:
        return replace(self, **changes)


def rate(r: Rates, duration: str = "duration_ms", error: str = "error_code") -> Column:
    """SMP-01: slow and failed spans at the high rate."""
    return F.when((F.col(duration) >= r.threshold_ms) | (F.col(error) >= ERROR_FROM), F.lit(r.high)).otherwise(F.lit(r.low))


def draw(key: str = "trace_id", salt: str = "") -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key))), 1, 8), 16, 10).cast("double") / 2**32


def keeps(rate_: Column, key: str = "trace_id", salt: str = "") -> Column:
    """SMP-02: everything at a rate of 1, nothing at 0."""
    return (rate_ >= 1) | ((rate_ > 0) & (draw(key, salt) < rate_))


def sampled(spans: DataFrame, r: Rates = Rates()) -> DataFrame:
    """SMP-02: spans on their own, with the rate and whether each is kept."""
    return spans.withColumn("rate", rate(r)).withColumn("kept", keeps(F.col("rate"), "span_id", "span:"))


def decisions(spans: DataFrame, r: Rates = Rates()) -> DataFrame:
    """SMP-04: one decision for each trace, by its first span (trace_id, rate, kept)."""
    first = spread(spans, tasks_of(spans), "trace_id").groupBy("trace_id").agg(F.min_by(F.struct("duration_ms", "error_code"), F.struct("start_ns", "span_id")).alias("f"))
    return first.select("trace_id", F.col("f.duration_ms").alias("duration_ms"), F.col("f.error_code").alias("error_code")).withColumn("rate", rate(r)).select("trace_id", "rate", keeps(F.col("rate")).alias("kept"))


def sampled_traces(spans: DataFrame, r: Rates = Rates(), forced: DataFrame | None = None) -> DataFrame:
    """SMP-04, SMP-06: all spans of the traces kept; traces in `forced` (trace_id) are always kept."""
    n = tasks_of(spans)
    ids = decisions(spans, r).filter("kept").select("trace_id")
    if forced is not None:
        ids = ids.unionByName(forced.select("trace_id"))
    return spans.join(spread(ids, n, "trace_id").distinct(), "trace_id", "left_semi")  # spans follow to as many tasks


def per_second(spans: DataFrame, seconds: int = 10, service: str | None = None) -> DataFrame:
    """SMP-05, ST-13: events per second over the trailing `seconds`. Events are counted by the second
    first; each second's count then goes to the seconds that it trails, so that no task sees them all."""
    second = F.expr("start_ns div 1000000000").alias("second")
    counts = spans.groupBy(second).agg(F.count(F.lit(1)).alias("n"))
    reached = counts.select("second", "n", F.explode(F.sequence(F.col("second"), F.col("second") + seconds - 1)).alias("at"))
    own = F.sum(F.when(F.col("second") == F.col("at"), F.col("n")))
    return reached.groupBy("at").agg(own.alias("n"), (F.sum("n") / seconds).alias("eps")).filter("n IS NOT NULL").select(F.col("at").alias("second"), "n", "eps")


def adaptive(spans: DataFrame, target_eps: float, r: Rates = Rates(), seconds: int = 10) -> DataFrame:
    """SMP-05: the full rate up to the target, then in inverse proportion; slow and failed spans
    pass by at the high rate."""
    load = per_second(spans, seconds).select(F.col("second").alias("s"), "eps")
    return rated(spans.join(load, F.expr("start_ns div 1000000000") == F.col("s")).drop("s"), target_eps, r)


def rated(spans: DataFrame, target_eps: float, r: Rates) -> DataFrame:
    """Spans with eps, the load of their second, with the rate that follows and whether each is kept."""
    by_load = F.when(F.col("eps") <= target_eps, 1.0).otherwise(r.low * target_eps / F.col("eps"))
    bypass = (F.col("duration_ms") >= r.threshold_ms) | (F.col("error_code") >= ERROR_FROM)
    return spans.withColumn("rate", F.when(bypass, F.lit(r.high)).otherwise(by_load)).withColumn("kept", keeps(F.col("rate"), "span_id", "adaptive:"))


def composite(*rates: Column, key: str = "span_id") -> tuple[Column, Column]:
    """SMP-07: (least rate, whether every sampler keeps the span); each draws for itself."""
    each = [keeps(c, key, f"{i}:") for i, c in enumerate(rates)]
    return F.least(*rates) if len(rates) > 1 else rates[0], functools.reduce(operator.and_, each)


def counters(kept: DataFrame) -> DataFrame:
    """AGG-15, over spans with rate and kept."""
    return kept.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kept")).alias("sampled"),
        F.count_if(F.col("kept") & (F.col("rate") >= 1)).alias("sampled_high"),
        F.count_if(F.col("kept") & (F.col("rate") < 1)).alias("sampled_low"),
        F.count_if(~F.col("kept")).alias("dropped"),
        (F.count_if(F.col("kept")) / F.count(F.lit(1))).alias("overall_rate"),
    )
