"""First-in-first-out queues of requests, replayed in parallel: one connection may lie on any number of tasks.

What an event does to the number of waiting requests is a shift between two bounds: a request min(most, n + 1), a response
max(0, n - 1), an open, a close or a silence 0. Such shifts compose to shifts (by, low, high), so a
slice of a connection has a summary of three numbers, found by a scan in arrays. Events are dealt by
range, so only the first and the last connection of a partition can go on elsewhere: two summaries a partition,
folded on the driver, tell every partition what its first connection starts with.

Requests of a connection are numbered. Requests leave the queue in that order, so the one that an event takes
out is known by its number alone, and (connection, number) is an evenly spread key by which requests
meet what became of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import materialise

FAR = np.int64(1) << 40
OPEN, CLOSE, REQUEST, RESPONSE = range(4)
CODES = {"open": OPEN, "close": CLOSE, "request": REQUEST}


class Slice(NamedTuple):
    """Of some successive events of a connection: the shift, requests, time of the first and of the last event."""

    key: str | None
    by: int
    low: int
    high: int
    requests: int
    first_ns: int
    last_ns: int


class Start(NamedTuple):
    """What a slice begins with: waiting requests, requests so far, time of the last event."""

    key: str | None
    waiting: int
    requests: int
    last_ns: int


def shifts(kind: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, low, high) of every event."""
    by = np.select([kind == REQUEST, kind == RESPONSE], [1, -1], 0).astype(np.int64)
    low = np.select([kind == REQUEST, kind == RESPONSE], [-FAR, 0], 0).astype(np.int64)
    high = np.select([kind == REQUEST, kind == RESPONSE], [most, FAR], 0).astype(np.int64)
    return by, low, high


def scanned(by: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every event the shift of all events up to it, by doubling."""
    by, low, high = by.copy(), low.copy(), high.copy()
    step = 1
    while step < len(by):
        b, lo, hi = by[step:], low[step:], high[step:]
        new_low, new_high = (np.minimum(hi, np.maximum(lo, x[:-step] + b)) for x in (low, high))
        by[step:] = np.clip(by[:-step] + b, -FAR, FAR)
        low[step:], high[step:] = new_low, new_high
        step *= 2
    return by, low, high


class Events:
    """A batch in arrays; rows sorted by connection, time and number."""

    def __init__(self, batch: pa.RecordBatch):
        self.keys = batch.column("conn_key")
        codes = self.keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        kinds = batch.column("kind").dictionary_encode(null_encoding="encode")
        self.kind = np.array([CODES.get(k, RESPONSE) for k in kinds.dictionary.to_pylist()], np.int64)[kinds.indices.to_numpy(zero_copy_only=False)]
        self.at = batch.column("ts_ns").to_numpy().astype(np.int64)
        self.n = batch.num_rows
        self.new = np.ones(self.n, dtype=bool)
        self.new[1:] = codes[1:] != codes[:-1]

    def key(self, i: int) -> str | None:
        return self.keys[i].as_py()


def slices(most: int, timeout_ns: int):
    """A partition to the summaries of its first and its last connection, first one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Slice | None = None
        last: Slice | None = None
        part = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            e = Events(b)
            begins = np.flatnonzero(e.new).tolist()
            for i, j in [(0, begins[1]), (begins[-1], e.n)] if len(begins) > 1 else [(0, e.n)]:
                by, low, high = shifts(e.kind[i:j], most)
                silent = np.zeros(j - i, dtype=bool)
                silent[1:] = np.diff(e.at[i:j]) > timeout_ns
                after = np.where(e.kind[i:j] == REQUEST, min(1, most), 0)
                by[silent], low[silent], high[silent] = 0, after[silent], after[silent]
                by, low, high = (int(x[-1]) for x in scanned(by, low, high))
                one = Slice(e.key(i), by, low, high, int((e.kind[i:j] == REQUEST).sum()), int(e.at[i]), int(e.at[j - 1]))
                if i == 0 and last is not None and last.key == one.key:
                    last = joined(last, one, timeout_ns)
                else:
                    first, last = first or last, one
        found = [s for s in (first, last) if s is not None]
        yield pa.RecordBatch.from_pylist([{"part": part, "nr": i, **s._asdict()} for i, s in enumerate(found)], schema=SLICE_SCHEMA)

    return run


SLICES = "part int, nr int, key string, by long, low long, high long, requests long, first_ns long, last_ns long"
SLICE_SCHEMA = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in SLICES.split(", ")])


def through(s: Slice, waiting: int) -> int:
    return min(s.high, max(s.low, waiting + s.by))


def joined(a: Slice, b: Slice, timeout_ns: int) -> Slice:
    """Both slices as one; a silence between them empties the queue."""
    if b.first_ns - a.last_ns > timeout_ns:
        low = high = through(b, 0)
        by = 0
    else:
        by, low, high = max(-int(FAR), min(int(FAR), a.by + b.by)), through(b, a.low), through(b, a.high)
    return Slice(a.key, by, low, high, a.requests + b.requests, a.first_ns, b.last_ns)


def starts(found: list[tuple[int, Slice]], timeout_ns: int) -> dict[int, Start]:
    """What each partition's first connection begins with, from the summaries in the order of the partitions."""
    out: dict[int, Start] = {}
    now: Start | None = None
    for part, s in found:
        here = now if now is not None and now.key == s.key else None
        if here is None:
            now = Start(s.key, through(s, 0), s.requests, s.last_ns)
            continue
        if part not in out:
            out[part] = here
        waiting = 0 if s.first_ns - here.last_ns > timeout_ns else here.waiting
        now = Start(s.key, through(s, waiting), here.requests + s.requests, s.last_ns)
    return out


FATES = "conn_key string, nr long, is_request boolean, span_id string, trace_id string, ts_ns long, tag string"
FATE_SCHEMA = pa.schema([("conn_key", pa.string()), ("nr", pa.int64()), ("is_request", pa.bool_()), ("span_id", pa.string()), ("trace_id", pa.string()), ("ts_ns", pa.int64()), ("tag", pa.string())])
#: The tag of requests that a new connection replaces.
VANISHED = "replaced"


def fates_of(begin: dict[int, Start], most: int, timeout_ns: int):
    """A partition's events to numbered requests, and to what takes requests out: a response or a tag.
    Responses without a request have no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for b in batches:
            if b.num_rows:
                e = Events(b)
                if part is None:
                    part = b.column("part")[0].as_py()
                    now = begin.get(part)
                yield from fates(e, b, now if now is not None and now.key == e.key(0) else None)
                now = e.end

    def fates(e: Events, b: pa.RecordBatch, now: Start | None) -> Iterator[pa.RecordBatch]:
        n, kind = e.n, e.kind
        new = e.new.copy()
        new[0] = now is None
        silent = np.zeros(n, dtype=bool)
        silent[1:] = (np.diff(e.at) > timeout_ns) & ~new[1:]
        silent[0] = now is not None and e.at[0] - now.last_ns > timeout_ns
        by, low, high = shifts(kind, most)
        fresh, after = new | silent, np.where(kind == REQUEST, min(1, most), 0)
        by[fresh], low[fresh], high[fresh] = 0, after[fresh], after[fresh]
        by, low, high = scanned(by, low, high)
        waiting = np.minimum(high, np.maximum(low, (now.waiting if now else 0) + by))  # after each event
        before = np.append(now.waiting if now else 0, waiting[:-1])
        is_request = kind == REQUEST
        total = np.cumsum(is_request)
        begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        sent = total - is_request - np.where(new[begins], total[begins] - is_request[begins], -(now.requests if now else 0))  # before each event
        at_start = np.where(fresh, 0, before)
        e.end = Start(e.key(n - 1), int(waiting[-1]), int(sent[-1] + is_request[-1]), int(e.at[-1]))

        rows, numbers, requests, tags = [np.flatnonzero(is_request)], [sent[is_request] + 1], [np.ones(int(is_request.sum()), bool)], [np.full(int(is_request.sum()), -1)]

        def out(at: np.ndarray, first: np.ndarray, count: np.ndarray, tag: int) -> None:
            """Events at take out so many requests from a number on."""
            rows.append(np.repeat(at, count))
            numbers.append(np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum()))
            requests.append(np.zeros(len(rows[-1]), bool))
            tags.append(np.full(len(rows[-1]), tag))

        lost = np.flatnonzero(silent & (before > 0))
        out(lost, sent[lost] - before[lost] + 1, before[lost], 0)
        for code, tag in ((OPEN, 1), (CLOSE, 2)):
            at = np.flatnonzero((kind == code) & (at_start > 0))
            out(at, sent[at] - at_start[at] + 1, at_start[at], tag)
        full = np.flatnonzero(is_request & (at_start >= most))
        out(full, sent[full] - at_start[full] + 1, np.ones(len(full), np.int64), 3)
        answers = np.flatnonzero((kind == RESPONSE) & (at_start > 0))
        out(answers, sent[answers] - at_start[answers] + 1, np.ones(len(answers), np.int64), -1)
        orphans = np.flatnonzero((kind == RESPONSE) & (at_start == 0))
        out(orphans, np.zeros(len(orphans), np.int64), np.ones(len(orphans), np.int64), 4)

        of, nr, tag = np.concatenate(rows), np.concatenate(numbers), np.concatenate(tags)
        names = pa.array(["connection_timeout", VANISHED, "connection_closed", "evicted", "orphan_response"])
        yield pa.RecordBatch.from_arrays(
            [
                b.column("conn_key").take(pa.array(of)),
                pa.array(nr, pa.int64(), mask=tag == 4),
                pa.array(np.concatenate(requests)),
                *[b.column(c).take(pa.array(of)) for c in ("span_id", "trace_id", "ts_ns")],
                names.take(pa.array(tag, pa.int64(), mask=tag < 0)),
            ],
            schema=FATE_SCHEMA,
        )

    return run


def fates(events: DataFrame, most: int, timeout_ns: int) -> DataFrame:
    """Events to rows of FATES: requests with their numbers, and what took which of them out."""
    names = ["conn_key", "kind", "ts_ns", "seq", "span_id", "trace_id"]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conn_key", "ts_ns", "seq")]
    dealt = materialise(events.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # Two rows a partition, however many events there are.
    found = dealt.mapInArrow(slices(most, timeout_ns), SLICES).orderBy("part", "nr").collect()
    begin = starts([(r.part, Slice(*r[2:])) for r in found], timeout_ns)
    return dealt.mapInArrow(fates_of(begin, most, timeout_ns), FATES)
