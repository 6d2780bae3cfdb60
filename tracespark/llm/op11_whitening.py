"""Whitening of embeddings by hierarchical merging of singular value decompositions.

The fit list is every different vector once. A partition keeps one summary of its rows: their
number, exact sums, mean, and all singular values and right vectors of the centred rows. Two summaries
merge by a decomposition of both scaled sets of vectors above each other, with the row
sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2) that the difference of the means adds. Nothing is cut off, so the merged values and
vectors are those of all rows. Summaries merge in groups of `fan`, level by level, until one
is left: d * d numbers for vectors of d entries, however many rows there are. That one goes to the driver.

Entries are x = floor(256 * c); n * x - S is taken in whole numbers before anything is rounded.

Defined cases: null vectors, empty ones and such with a null or non-finite entry take no part; of vectors of several
lengths only those of the commonest length do (of equally common ones the longest); x saturates at the
range of a long; components without variance (rank below the dimension, or all vectors equal) have
whitened null and take no part in identity_error; deviation is null beyond a long (38 digits in the
operator); rows of equal id or vector each have their rows; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, COMPONENTS = 256.0, 4
#: Numbers of a block of rows that are decomposed together, and bytes of the summaries that one task merges.
BLOCK, MERGED = 1 << 18, 64 << 20
#: Singular values below that share of the largest, times the dimension, are rounding.
NOTHING = 1e-15
SUMMARY = "part int, n long, sums array<decimal(38,0)>, mean array<double>, factor binary"
SUMMARY_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("factor", pa.binary())])
LIMIT = 10**38


class Summary(NamedTuple):
    """Of some rows: factor.T @ factor is n times their covariance; its rows are singular values times vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    factor: np.ndarray


class Model(NamedTuple):
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    #: Unit eigenvectors as rows, by falling eigenvalue.
    components: np.ndarray
    trace: float


def reduced(rows: np.ndarray) -> np.ndarray:
    """As many rows as columns at most, with the same singular values and right vectors."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summary_of(x: np.ndarray) -> Summary:
    top = int(np.abs(x, dtype=np.float64).max()) + 1
    sums = x.sum(axis=0) if top * len(x) < 2**62 else x.astype(object).sum(axis=0)
    mean = np.array([s / len(x) for s in sums.tolist()])
    return Summary(len(x), sums.tolist(), mean, reduced(x - mean))


def merged(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    correction = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    sums = [int(s) + int(t) for s, t in zip(a.sums, b.sums, strict=True)]
    return Summary(n, sums, np.array([s / n for s in sums]), reduced(np.vstack([a.factor, b.factor, correction])))


def packed(part: int, s: Summary) -> pa.RecordBatch:
    row = {"part": part, "n": s.n, "sums": [Decimal(int(v)) for v in s.sums], "mean": s.mean.tolist(), "factor": s.factor.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=SUMMARY_SCHEMA)


def unpacked(t: pa.Table) -> Iterator[Summary]:
    for r in sorted(t.to_pylist(), key=lambda r: r["part"]):
        yield Summary(r["n"], [int(v) for v in r["sums"]], np.array(r["mean"]), np.frombuffer(r["factor"]).reshape(-1, len(r["mean"])))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(rows: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part with their x, and the length of these."""
    c = F.col(vec_col)
    entry = lambda v: v.cast("double")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(entry(v)) & (F.abs(entry(v)) != float("inf")))
    rows = rows.filter(c.isNotNull() & (F.size(c) > 0)).filter(finite)
    rows = rows.withColumn("x", F.transform(c, lambda v: F.floor(F.lit(SCALE) * entry(v))))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return rows.filter(F.size("x") == d), d


def fit(vectors: DataFrame, d: int) -> Model:
    """vectors: x, each different one once, materialised, so that a lost partition comes back the same."""
    block = max(1, BLOCK // d)

    def run(batches_in):
        so_far: Summary | None = None
        held, n = [], 0

        def add(so_far: Summary | None) -> Summary:
            s = summary_of(np.concatenate(held))
            held.clear()
            return s if so_far is None else merged(so_far, s)

        for b in batches_in:
            x = matrix(b.column("x"), d)
            for i in range(0, len(x), block):
                held.append(x[i : i + block])
                n += len(held[-1])
                if n >= block:
                    so_far, n = add(so_far), 0
        if n:
            so_far = add(so_far)
        if so_far is not None:
            yield packed(TaskContext.get().partitionId(), so_far)

    def merge(t: pa.Table) -> pa.Table:
        every = unpacked(t)
        out = next(every)
        for s in every:
            out = merged(out, s)
        return pa.Table.from_batches([packed(t.column("part")[0].as_py() // fan, out)])

    fan = max(2, min(16, MERGED // (8 * d * d)))
    left = vectors.rdd.getNumPartitions()
    found = vectors.select("x").mapInArrow(run, SUMMARY)
    while left > 1:
        found = found.groupBy(F.expr(f"part div {fan}")).applyInArrow(merge, SUMMARY)
        left = -(-left // fan)
    s = next(unpacked(found.toArrow()))
    eigenvalues = np.zeros(d)
    _, values, vectors_ = np.linalg.svd(s.factor, full_matrices=False)
    values = np.where(values > values[0] * d * NOTHING, values, 0) if len(values) else values
    eigenvalues[: len(values)] = values**2 / s.n
    components = np.zeros((d, d))
    components[: len(vectors_)] = vectors_
    return Model(s.n, s.sums, eigenvalues, components, float(eigenvalues.sum()))


def differences(x: np.ndarray, m: Model) -> np.ndarray:
    """n * x - S in whole numbers: of 64 bits where that can't overflow."""
    most = max(1, int(np.abs(x, dtype=np.float64).max(initial=0)) + 1) * m.n + max(map(abs, m.sums))
    return m.n * x - np.array(m.sums, dtype=np.int64) if most < 2**62 else m.n * x.astype(object) - np.array(m.sums, dtype=object)


def deviations(diff: np.ndarray) -> list[int | None]:
    if diff.dtype != object and int(np.abs(diff).max(initial=0)) ** 2 * diff.shape[1] < 2**62:
        return (diff * diff).sum(axis=1).tolist()
    every = (sum(int(v) ** 2 for v in row) for row in diff.tolist())
    return [v if v < LIMIT else None for v in every]


def whitened_of(diff: np.ndarray, m: Model, k: int) -> np.ndarray:
    """Of rows n * x - S, the first k whitened components."""
    return (diff.astype(np.float64) / m.n) @ (m.components[:k] / np.sqrt(m.eigenvalues[:k])[:, None]).T


def identity_error(vectors: DataFrame, m: Model, d: int, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = int(np.count_nonzero(m.eigenvalues[:components]))
    if not k:
        return 0.0

    def run(batches_in):
        total = np.zeros((k, k))
        for b in batches_in:
            w = whitened_of(differences(matrix(b.column("x"), d), m), m, k)
            total += w.T @ w
        yield pa.RecordBatch.from_pylist([{"total": total.ravel().tolist()}])

    sums = vectors.select("x").mapInArrow(run, "total array<double>").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("s"))
    one = F.when(F.col("pos") % (k + 1) == 0, 1.0).otherwise(0.0)
    return sums.agg(F.max(F.abs(F.col("s") / m.n - one))).first()[0]


WHITENED = "component int, deviation decimal(38,0), whitened double, explained double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int | None = None) -> DataFrame:
    """A row for each usable row and component: the id, component (from 1), n (different vectors), deviation (exact,
    of n * x from S), whitened, explained (share of the variance), identity_error."""
    rows, d = usable(rows.select(F.col(id_col).alias(id_col), F.col(vec_col).alias(vec_col)), vec_col)
    components = min(d, components or d)
    rows = rows.select(id_col, "x")
    out = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {WHITENED}"
    if not d:
        return rows.sparkSession.createDataFrame([], out).select(id_col, "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(0.0).alias("identity_error"))
    vectors = materialise(rows.select("x").distinct())
    m = fit(vectors, d)
    error = identity_error(vectors, m, d, components)
    k = int(np.count_nonzero(m.eigenvalues[:components]))
    explained = (m.eigenvalues[:components] / m.trace).tolist() if m.trace else [None] * components
    m = m._replace(components=m.components[:k])  # what the tasks need

    def run(batches_in):
        for b in batches_in:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                diff = differences(matrix(part.column("x"), d), m)
                w = np.full((len(diff), components), np.nan)
                w[:, :k] = whitened_of(diff, m, k)
                of = pa.array(np.repeat(np.arange(len(diff)), components))
                deviation = pa.array([None if v is None else Decimal(v) for v in deviations(diff)], pa.decimal128(38, 0))
                number = pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(diff)))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(of), number, deviation.take(of), pa.array(w.ravel(), from_pandas=True), pa.array(explained * len(diff), pa.float64())], [id_col, "component", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, out).select(id_col, "component", F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def query(spark, sf_dir):
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=COMPONENTS)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
