"""Latency anomalies: moving averages for each operation, thresholds, alerts with a cooldown.

The average and the variance are folds in the order of time. A slice of a key's time (an hour) maps the
average linearly and the variance quadratically, so slices are summed up apart, their summaries are
folded by key, and each slice is then folded from its own start: a key of any size is dealt over tasks,
and a task needs the memory of a batch.

With alpha = 0.2 a sample can't exceed its own updated threshold for k >= 2: alerts need
k < sqrt((1 - alpha) / alpha). mode="prior" compares with the state before the sample instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import by_key, stretches

KEY = ["service_name", "operation", "protocol"]


@dataclass(frozen=True)
class Detector:
    """alpha: weight of a new sample; k: deviations; cooldown and idle time in seconds."""

    alpha: float = 0.2
    k: float = 3.0
    least: int = 100
    cooldown_s: float = 60
    idle_s: float = 3600
    mode: str = "post"

    def severity(self, deviation: float) -> str:
        return "critical" if deviation > 500 else "error" if deviation > 200 else "warning"


class State:
    """The running state of one key, sample by sample: what a stream keeps."""

    __slots__ = ("n", "total", "squares", "ewma", "var", "seen_ns", "sent")

    def __init__(self):
        self.n, self.total, self.squares, self.ewma, self.var, self.seen_ns, self.sent = 0, 0.0, 0.0, 0.0, 0.0, None, {}

    def add(self, d: Detector, x: float, at_ns: int) -> dict:
        """The state after a sample, and whether it is an anomaly and is sent."""
        if self.seen_ns is not None and at_ns - self.seen_ns > d.idle_s * 1e9:
            self.__init__()
        before, spread = self.ewma, self.var
        self.n, self.total, self.squares, self.seen_ns = self.n + 1, self.total + x, self.squares + x * x, at_ns
        if self.n == 1:
            self.ewma, self.var = x, 0.0
        else:
            diff = x - self.ewma
            self.ewma += d.alpha * diff
            self.var = (1 - d.alpha) * (self.var + d.alpha * diff * diff)
        mean = self.total / self.n
        stddev = math.sqrt(max(0.0, (self.squares - self.total * self.total / self.n) / (self.n - 1))) if self.n > 1 else 0.0
        e, v = (before, spread) if d.mode == "prior" else (self.ewma, self.var)
        threshold = e + d.k * math.sqrt(v)
        anomaly = self.n >= d.least and x > threshold and e > 0
        deviation = (x - e) / e * 100 if e else 0.0
        severity = d.severity(deviation) if anomaly else None
        sent = anomaly and (severity not in self.sent or at_ns - self.sent[severity] > d.cooldown_s * 1e9)
        if sent:
            self.sent[severity] = at_ns
        return dict(n=self.n, mean=mean, stddev=stddev, ewma=self.ewma, ewma_var=self.var, threshold=threshold, deviation=deviation, is_anomaly=anomaly, severity=severity, is_sent=sent)


SAMPLE = "trace_id string, span_id string, service_name string, operation string, protocol string, start_ns long, duration_ms double"
FOLDED_SCHEMA = pa.schema([("n", pa.int64()), *[(c, pa.float64()) for c in ("mean", "stddev", "ewma", "ewma_var", "threshold", "deviation")], ("is_anomaly", pa.bool_()), ("severity", pa.string()), ("is_sent", pa.bool_())])


KEYS = ", ".join(f"{c} string" for c in KEY)
SUMMARY = f"{KEYS}, slice long, first_ns long, since_ns long, last_ns long, resets boolean, n long, total double, squares double, x double, ewma double, var double, c double, r double, s double"
START = "n long, total double, squares double, ewma double, var double, last_ns long, since_ns long"
BATCH_FOLDED = "n long, mean double, stddev double, ewma double, ewma_var double, threshold double, deviation double, is_anomaly boolean, severity string, since_ns long"
START_SCHEMA = pa.struct([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in START.split(", ")])


@dataclass(frozen=True)
class Run:
    """Samples of a key since `since_ns`: their sums, and the average and variance after them."""

    n: int = 0
    total: float = 0.0
    squares: float = 0.0
    ewma: float = 0.0
    var: float = 0.0
    last_ns: int | None = None
    since_ns: int | None = None


@dataclass(frozen=True)
class Summary:
    """A stretch of samples without a look at what came before. `run` is the state of a run that begins with
    them, at x; begun at an average of x + u and a variance of v, the average is ewma + c * u and the
    variance var + c * v + r * u + s * u * u."""

    run: Run
    x: float
    c: float = 1.0
    r: float = 0.0
    s: float = 0.0

    def after(self, before: Run) -> Run:
        u, own = before.ewma - self.x, self.run
        return Run(before.n + own.n, before.total + own.total, before.squares + own.squares, own.ewma + self.c * u, own.var + self.c * before.var + self.r * u + self.s * u * u, own.last_ns, before.since_ns)


def step(d: Detector, run: Run, x: np.ndarray, at: np.ndarray) -> tuple[Run, dict[str, np.ndarray]]:
    """The run after samples without an idle gap, and its columns after each of them."""
    keep, since = 1 - d.alpha, int(at[0]) if run.n == 0 else run.since_ns
    e, v = (float(x[0]), 0.0) if run.n == 0 else (run.ewma, run.var)
    ewma, var = [run.ewma], [run.var]
    for sample in x.tolist():
        diff = sample - e
        e += d.alpha * diff
        v = keep * (v + d.alpha * diff * diff)
        ewma.append(e)
        var.append(v)
    n, total, squares = run.n + np.arange(1, len(x) + 1), np.cumsum(np.concatenate(([run.total], x)))[1:], np.cumsum(np.concatenate(([run.squares], x * x)))[1:]
    out = dict(n=n, total=total, squares=squares, ewma=np.array(ewma[1:]), ewma_var=np.array(var[1:]), before=np.array(ewma[:-1]), spread=np.array(var[:-1]), since_ns=np.full(len(x), since))
    return Run(int(n[-1]), float(total[-1]), float(squares[-1]), e, v, int(at[-1]), since), out


def summed(d: Detector, so_far: Summary | None, x: np.ndarray, at: np.ndarray) -> Summary:
    """The summary with further samples."""
    so_far = so_far or Summary(Run(), float(x[0]))
    keep, c, r, s = 1 - d.alpha, so_far.c, so_far.r, so_far.s
    run, out = step(d, so_far.run, x, at)
    before = out["before"]
    before[0] = before[0] if so_far.run.n else x[0]
    for diff in (x - before).tolist():
        r = keep * (r - 2 * d.alpha * diff * c)
        s = keep * (s + d.alpha * c * c)
        c *= keep
    return replace(so_far, run=run, c=c, r=r, s=s)


def judged(d: Detector, found: dict[str, np.ndarray], x: np.ndarray) -> list[pa.Array]:
    """The columns of BATCH_FOLDED."""
    n, total = found["n"], found["total"]
    spread = np.maximum(0.0, (found["squares"] - total * total / n) / np.maximum(n - 1, 1))
    e, v = (found["before"], found["spread"]) if d.mode == "prior" else (found["ewma"], found["ewma_var"])
    threshold = e + d.k * np.sqrt(v)
    anomaly = (n >= d.least) & (x > threshold) & (e > 0)
    deviation = np.divide(x - e, e, out=np.zeros(len(x)), where=e != 0) * 100
    severity = [d.severity(y) if a else None for a, y in zip(anomaly.tolist(), deviation.tolist(), strict=True)] if anomaly.any() else [None] * len(x)
    return [pa.array(n), pa.array(total / n), pa.array(np.where(n > 1, np.sqrt(spread), 0.0)), *map(pa.array, (found["ewma"], found["ewma_var"], threshold, deviation, anomaly)), pa.array(severity, pa.string()), pa.array(found["since_ns"])]


def starts(spans: DataFrame, d: Detector) -> DataFrame:
    """The run in which each slice of a key begins: (key, slice, start), start null where there was none."""

    def summaries(batches):
        key = so_far = first = None
        resets = False

        def told():
            own = so_far.run
            return (*key, first, own.since_ns, own.last_ns, resets, own.n, own.total, own.squares, so_far.x, own.ewma, own.var, so_far.c, so_far.r, so_far.s)

        names = [c.split()[0] for c in SUMMARY.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in SUMMARY.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            x, at, rows = b.column("duration_ms").to_numpy(), b.column("start_ns").to_numpy(), []
            for now, i, j in stretches(b, [*KEY, "slice"], at, d.idle_s * 1e9):
                if now != key:
                    if key is not None:
                        rows.append(told())
                    key, so_far, first, resets = now, None, int(at[i]), False
                elif at[i] - so_far.run.last_ns > d.idle_s * 1e9:
                    so_far, resets = None, True
                so_far = summed(d, so_far, x[i:j], at[i:j])
            if rows:
                yield made(rows)
        if key is not None:
            yield made([told()])

    def follow(batches):
        key = run = None
        for b in batches:
            found = []
            for row in b.to_pylist():
                if [row[c] for c in KEY] != key:
                    key, run = [row[c] for c in KEY], None
                if run is not None and row["first_ns"] - run.last_ns > d.idle_s * 1e9:
                    run = None
                found.append(None if run is None else vars(run))
                own = Summary(Run(*[row[c] for c in ("n", "total", "squares", "ewma", "var", "last_ns", "since_ns")]), *[row[c] for c in "xcrs"])
                run = own.run if run is None or row["resets"] else own.after(run)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*KEY, "slice")], pa.array(found, START_SCHEMA)], [*KEY, "slice", "start"])

    parts = by_key(spans.select(*KEY, "slice", "start_ns", "span_id", "duration_ms"), [*KEY, "slice"], ["start_ns", "span_id"], summaries, SUMMARY)
    return by_key(parts, KEY, ["slice"], follow, f"{KEYS}, slice long, start struct<{', '.join(c.replace(' ', ':') for c in START.split(', '))}>")


def fold(spans: DataFrame, d: Detector = Detector(), slice_s: float = 3600) -> DataFrame:
    """A-01 to A-05, A-09: every sample with the state after it. FLT-08: durations that are null or not
    positive are passed over, and so are samples without a time. since_ns is the first sample of the run,
    which an idle gap ends. A task folds `slice_s` seconds of a key at a time."""
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    sliced = spans.filter("duration_ms > 0 AND start_ns IS NOT NULL").select(*names, F.expr(f"start_ns div {int(slice_s * 1e9)}").alias("slice"))
    begun = starts(sliced, d)

    def run(batches):
        key, now = None, Run()
        for b in batches:
            at = b.column("start_ns").fill_null(0).to_numpy()
            x, begins, kept = b.column("duration_ms").fill_null(0).to_numpy(), b.column("start_ns").is_null().to_numpy(zero_copy_only=False), []
            for k, i, j in stretches(b, [*KEY, "slice"], at, d.idle_s * 1e9):
                if begins[i]:  # the row that says how the slice begins comes before its samples
                    given = b.column("start")[i].as_py()
                    key, now, i = k, Run(**given) if given else Run(), i + 1
                if i == j:
                    continue
                if now.last_ns is not None and at[i] - now.last_ns > d.idle_s * 1e9:
                    now = Run()
                now, out = step(d, now, x[i:j], at[i:j])
                kept.append(out)
            if kept:
                found = {c: np.concatenate([o[c] for o in kept]) for c in kept[0]}
                rows = b.filter(pa.array(~begins))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], *judged(d, found, x[~begins])], [*names, *[c.split()[0] for c in BATCH_FOLDED.split(", ")]])

    both = sliced.unionByName(begun, allowMissingColumns=True)
    return by_key(both, [*KEY, "slice"], ["start_ns", "span_id"], run, f"{SAMPLE}, {BATCH_FOLDED}")


def sent(folded: DataFrame, d: Detector = Detector()) -> DataFrame:
    """A-07: the anomalies of a fold, with whether each is sent: not within the cooldown after one of the
    same severity in the same run. Only anomalies are shuffled."""

    def run(batches):
        key = last = None
        for b in batches:
            out = []
            for *now, at, since in zip(*[b.column(c).to_pylist() for c in (*KEY, "severity", "start_ns", "since_ns")], strict=True):
                if now != key:
                    key, last = now, None
                out.append(last is None or last < since or at - last > d.cooldown_s * 1e9)
                last = at if out[-1] else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "is_sent"])

    return by_key(folded.filter("is_anomaly"), [*KEY, "severity"], ["start_ns", "span_id"], run, f"{SAMPLE}, {BATCH_FOLDED}, is_sent boolean")


def moments(spans: DataFrame) -> DataFrame:
    """AGG-11, A-02: count, mean and sample deviation for each key."""
    return spans.filter("duration_ms > 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"), F.avg("duration_ms").alias("mean"), F.coalesce(F.stddev_samp("duration_ms"), F.lit(0.0)).alias("stddev"))


def description(x: Column, threshold: Column) -> Column:
    """A-06."""
    return F.format_string("Latency of %.2f ms is over the threshold of %.2f ms", x, threshold)


def alerts(folded: DataFrame, sent_only: bool = True, d: Detector = Detector()) -> DataFrame:
    """A-06: the alert records, those that are sent (a stream's rows tell) or all."""
    told = folded if not sent_only or "is_sent" in folded.columns else sent(folded, d)
    found = told.filter("is_sent" if sent_only else "is_anomaly")
    return found.select("trace_id", "span_id", *KEY, F.timestamp_micros(F.expr("start_ns div 1000")).alias("timestamp"), "severity", F.lit("latency_spike").alias("anomaly_type"), description(F.col("duration_ms"), F.col("threshold")).alias("description"), F.col("duration_ms").alias("current_value"), "threshold", "deviation")


def alert_body(alert: DataFrame) -> DataFrame:
    """SNK-07: the JSON body that an alert manager takes for each alert."""
    text = lambda form, c: F.format_string(form, F.col(c))
    labels = F.struct(F.lit("LatencyAnomaly").alias("alertname"), "severity", F.col("service_name").alias("service"), "operation", "trace_id", "span_id", "anomaly_type")
    notes = F.struct("description", text("%.2fms", "current_value").alias("current"), text("%.2fms", "threshold").alias("threshold"), text("%.1f%%", "deviation").alias("deviation"))
    starts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt")
    return alert.select("span_id", F.to_json(F.array(F.struct(labels.alias("labels"), notes.alias("annotations"), starts))).alias("body"))


def latest(folded: DataFrame) -> DataFrame:
    """A-11: the last state of each key."""
    return folded.groupBy(*KEY).agg(F.max_by(F.struct("n", "mean", "stddev", "ewma", "ewma_var"), F.struct("start_ns", "span_id")).alias("s")).select(*KEY, "s.*")


def listing(folded: DataFrame) -> DataFrame:
    """AGG-18: the statistics page; its threshold is the average plus three sample deviations."""
    return latest(folded).withColumn("listed_threshold", F.col("ewma") + 3 * F.col("stddev"))
