"""Rows of packed arrays: what tasks send to the bucket that needs it, many entries to a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries of a packed row.
ENTRIES = 4000
PACKED = "bucket int, kind int, data binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PRIME = 2**31 - 1
Table = dict[str, np.ndarray]
Fields = dict[str, str]


def pack(fields: Fields, t: Table) -> bytes:
    return b"".join(np.ascontiguousarray(t[f], dtype=np.dtype(d).base).tobytes() for f, d in fields.items())


def unpack(fields: Fields, blobs: list[bytes]) -> Table:
    width = sum(np.dtype(d).itemsize for d in fields.values())
    parts: dict[str, list] = {f: [] for f in fields}
    for b in blobs:
        n, at = len(b) // width, 0
        for f, d in fields.items():
            d = np.dtype(d)
            parts[f].append(np.frombuffer(b, dtype=d.base, count=n * (d.itemsize // d.base.itemsize), offset=at).reshape(n, *d.shape))
            at += n * d.itemsize
    return {f: np.concatenate(v) if v else np.zeros((0, *np.dtype(fields[f]).shape), np.dtype(fields[f]).base) for f, v in parts.items()}


def take(t: Table, of) -> Table:
    return {f: v[of] for f, v in t.items()}


def size(t: Table) -> int:
    return len(next(iter(t.values())))


def joined(parts: list[Table], fields) -> Table:
    return {f: np.concatenate([p[f] for p in parts]) for f in fields}


def in_rows(bucket: np.ndarray, entries: int = ENTRIES) -> Iterator[tuple[int, int, int]]:
    """(bucket, first entry, end) of rows of at most so many entries; bucket is sorted."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for i in range(a, b, entries):
            yield int(bucket[a]), i, min(b, i + entries)


def batches_of(rows: Iterator[tuple[int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for row in rows:
        held.append(row)
        total += len(row[2])
        if total > limit:
            yield batch_of(held)
            held, total = [], 0
    if held:
        yield batch_of(held)


def send(kind: int, fields: Fields, t: Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows of at most ENTRIES entries of one bucket."""
    order = np.argsort(bucket, kind="stable")
    t, bucket = take(t, order), bucket[order]
    return batches_of((of, kind, pack(fields, take(t, slice(i, j)))) for of, i, j in in_rows(bucket))


def batch_of(rows) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], schema=SCHEMA)


def as_table(made: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(made, schema=SCHEMA)


def by_kind(packed: pa.Table, kinds) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {k: [] for k in kinds}
    for k, d in zip(packed.column("kind").to_pylist(), packed.column("data").to_pylist(), strict=True):
        out[k].append(d)
    return out


def row_bucket(doc: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a row by its document and key."""
    return ((doc.astype(np.int64) % PRIME * 48271 + k.astype(np.int64) % PRIME * 69621) % PRIME % n).astype(np.int32)


def row_bucket_column(doc: str, k: str, n: int):
    """The same in SQL."""
    from pyspark.sql import functions as F

    return ((F.pmod(F.col(doc), F.lit(PRIME)) * 48271 + F.pmod(F.col(k), F.lit(PRIME)) * 69621) % PRIME % n).cast("int")


def entries_of(t: Table, doc: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first entry, end): the slice of t's entries that belong to each row; t is sorted by (doc, k)."""
    key = np.empty(size(t), dtype=[("doc", "i8"), ("k", "i8")])
    key["doc"], key["k"] = t["doc"], t["k"]
    own = np.empty(len(doc), dtype=key.dtype)
    own["doc"], own["k"] = doc, k
    return zip(range(len(doc)), np.searchsorted(key, own, side="left").tolist(), np.searchsorted(key, own, side="right").tolist(), strict=True)


def merged(t: Table) -> Table:
    """Marks (doc, k, start, end) as maximal runs, sorted."""
    if not size(t):
        return t
    t = take(t, np.lexsort((t["start"], t["k"], t["doc"])))
    new_row = np.zeros(size(t), dtype=bool)
    new_row[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["k"][1:] != t["k"][:-1])
    run = np.cumsum(new_row)
    wide = np.int64(1) << 33
    reach = np.maximum.accumulate(t["end"].astype(np.int64) + run * wide) - run * wide
    new = np.ones(size(t), dtype=bool)
    new[1:] = new_row[1:] | (t["start"][1:] > reach[:-1])
    first = np.flatnonzero(new)
    return {"doc": t["doc"][first], "k": t["k"][first], "start": t["start"][first], "end": np.maximum.reduceat(t["end"], first)}
