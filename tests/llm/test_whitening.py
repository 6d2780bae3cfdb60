import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracespark.llm import op11_whitening as op11

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", "n", 1) for i, v in rows], SCHEMA)


def brute(rows, k=4):
    """By one covariance matrix of the different vectors."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in usable}))
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, v in usable:
        diff = [n * a - int(b) for a, b in zip(v, s, strict=True)]
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, sum(d * d for d in diff), float((np.array(v) - s / n) @ q[:, c] / math.sqrt(e[c])), e[c] / e.sum()))
    return out


def compare(got, want):
    signs = {}
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        if abs(whitened) > 1e-6:
            sign = signs.setdefault(r.component, math.copysign(1, r.whitened * whitened))
            assert r.whitened * sign == pytest.approx(whitened, rel=1e-6, abs=1e-8)
        assert r.identity_error <= 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(1, 3, d)
    rows = [(i, (rng.normal(size=d) @ mix + 5).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are copies


@pytest.mark.parametrize("block,d", [(1 << 18, 8), (40, 8), (1 << 18, 5)])
def test_against_one_covariance(spark, monkeypatch, block, d):
    monkeypatch.setattr(op11, "BLOCK", block)
    rows = vectors(d, 300, d)
    compare(op11.whiten(frame(spark, rows).repartition(7), components=4).collect(), brute(rows))


def test_levels_of_merges(spark, monkeypatch):
    """Summaries merged two at a time over several levels give what one summary does."""
    monkeypatch.setattr(op11, "MERGED", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = vectors(3, 200, 6)
        compare(op11.whiten(frame(spark, rows), components=4).collect(), brute(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merging_is_lossless():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (90, 7))
    a = op11.merged(op11.merged(op11.summary_of(x[:3]), op11.summary_of(x[3:50])), op11.summary_of(x[50:]))
    centred = x - x.mean(axis=0)
    assert np.allclose(a.factor.T @ a.factor, centred.T @ centred, rtol=1e-12, atol=1e-8)
    assert a.sums == x.sum(axis=0).tolist() and a.n == 90 and len(a.factor) == 7


def test_odd_tables(spark):
    rows = vectors(4, 40, 4)
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (None, rows[1][1]), (5, rows[2][1]), (5, rows[2][1])]
    got = op11.whiten(frame(spark, rows + odd), components=4).collect()
    ids = [r.vec_id for r in got]
    assert len(got) == 4 * (len(rows) + 3) and ids.count(5) == 12 and ids.count(None) == 4 and not {900, 901, 902, 903, 904, 905} & set(ids)
    assert op11.whiten(frame(spark, [])).count() == 0 and op11.whiten(frame(spark, odd[:5])).count() == 0


def test_components_without_variance(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    got = op11.whiten(frame(spark, flat)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) for r in got) and got[0].identity_error < 1e-9
    equal = op11.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(3)])).collect()
    assert len(equal) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in equal)


def test_whole_numbers_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 1e15, rng.uniform(-1, 1) * 1e12, rng.uniform(-1, 1)]) for i in range(30)]
    got = op11.whiten(frame(spark, rows), components=1).select("vec_id", F.col("deviation").cast("string")).collect()
    want = brute(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: v[0][1] for (i, _), v in want.items()}


def test_query_against_one_covariance(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op11.query(spark, sf).collect(), brute(rows))
