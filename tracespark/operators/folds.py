"""Sequential folds over sorted rows: one shuffle by key, rows streamed through in order."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys on one task, by a hash of the keys. A repartition by the keys themselves is left out of the plan where a
    join below it deals by them already, and is missing once that join turns into a broadcast at run time."""
    return df.repartition(F.xxhash64(*keys))


#: Rows that a task of a join or a sort should have, about 100 to 250 MB of memory.
ROWS = 1_000_000


def tasks_of(df: DataFrame) -> int:
    """How many tasks give each about ROWS of df's rows; 0 where that isn't more than the session's cores, whose tasks Spark may
    deal and join as it likes. Without a number Spark takes as many tasks for large tables as for small ones, or fewer, as it
    goes by compressed bytes, and ids compress well; then the memory of a task grows with the table."""
    if df.isStreaming:
        return 0
    n = -(-df.count() // ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by its keys to n tasks, of which none are merged; as it is if n is 0."""
    return df.repartition(n, *keys) if n else df


def by_key(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """run sees the rows of each key together and in order, batch by batch: a key of any size passes
    with the memory of a batch."""
    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where the key changes, so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        last, cut = values[-1], batch.num_rows - 1
        while cut and values[cut - 1] == last:
            cut -= 1
        if cut == 0 and (not held or held[-1].column(key)[-1] == last):
            held.append(batch)
            continue
        head = [*held, batch.slice(0, cut)] if cut else held
        if head:
            yield pa.Table.from_batches(head)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def stretches(batch: pa.RecordBatch, keys: list[str], at: np.ndarray, gap: float) -> Iterator[tuple[list, int, int]]:
    """(key, first row, end) of every stretch of a batch in which no key changes and no row is more than `gap`
    after the one before."""
    if not batch.num_rows:
        return
    new = np.diff(at) > gap
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    ends = [*(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for i, j in zip([0, *ends[:-1]], ends, strict=True):
        yield [batch.column(k)[i].as_py() for k in keys], i, j


def materialise(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, whoever reads them again: a reliable checkpoint in
    spark.checkpoint.dir. Where that is unset, a session inside one process (tests) gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
