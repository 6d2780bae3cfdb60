import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from tracespark.llm import op2_language_id as op2
from tracespark.llm import op3_exact_topk as op3
from tracespark.llm import op5_mixing as op5
from tracespark.llm import op8_quality as op8


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op2.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 200 and right / n > 0.97


def test_language_hierarchy_and_ties():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (20, 4)) for c in np.eye(4)]).astype(np.float32)
    langs = np.repeat(np.array(["en", "de", "fr", "es"], dtype=object), 20)
    h = op2.Hierarchy(x, langs)
    assert h.top.classes == ["germanic", "romance"] and [m.classes for m in h.within] == [["de", "en"], ["es", "fr"]]
    pred, score = h.predict(x)
    assert (pred == langs).all() and ((score > 0.5) & (score <= 1)).all()
    alone = op2.Hierarchy(x[:20], langs[:20])
    assert set(alone.predict(x)[0]) == {"en"}


def test_language_odd_tables(spark):
    docs = odd_documents(spark)
    model = op2.fit(docs)
    got = op2.predict(docs, model)
    assert got.columns == ["row", "lang_pred", "score"]
    by_id = {(r.row.doc_id, r.row.text): r for r in got.collect()}
    assert by_id[3, None].lang_pred == "und" and by_id[3, None].score == 0
    assert by_id[9, "12 34 !!"].lang_pred == "und" and by_id[1, next(t for i, t in by_id if i == 1)].lang_pred != "und"
    assert {r.lang_pred for r in op2.predict(docs, None).collect()} == {"und"}
    assert op2.fit(no_documents(spark)) is None
    assert op2.predict(no_documents(spark), model).count() == 0


def brute_top(rows, k, every=50):
    codes = {i: (i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q, (_, a) in codes.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in codes.values() if i != q and len(a) == len(b))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("size", [(4096, 65536), (30, 30)])
def test_top_k_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(op3, "CANDIDATES", size)
    monkeypatch.setattr(op3, "QUERIES", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 0, 0.5, 1]) * rng.random() for _ in range(20)]) for i in range(0, 600, 2)]
    rows += [(1001 + i, rows[0][1]) for i in range(30)] + [(2001, None), (2050, [float("nan")] * 20), (2052, [None] * 20), (2100, [1.0, 2.0]), (2151, [3.0, 4.0]), (2153, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in op3.top_k(df.filter("vec_id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute_top(rows, 5)


def test_top_k_of_one_id_with_two_vectors(spark, monkeypatch):
    monkeypatch.setattr(op3, "COMPONENTS", 40)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])] + [(i, [i / 100, 1 - i / 100]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in op3.top_k(df.filter("vec_id = 0"), df, 5).collect())
    assert got == sorted([(k + 1, 59 - k) for k in range(5)] + [(k + 1, k + 1) for k in range(5)])


def plain_features(text):
    """The square roots of letter-trigram shares, one trigram at a time."""
    b = [x if x >= 128 or 97 <= x <= 122 else 0 for x in text.lower().encode()]
    out = [0.0] * op2.DIM
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        out[((x << 16 | y << 8 | z) * 0x9E3779B1 % 2**32) >> (32 - op2.DIM.bit_length() + 1)] += 1
    return [(v / max(1, sum(out))) ** 0.5 for v in out] if any(out) else out


def plain_winner(machines, x):
    """The class with the most votes, then the largest margins, and how sure its least margin is."""
    votes, margins = dict.fromkeys(machines.classes, 0.0), {}
    for (a, b), w in zip(itertools.combinations(machines.classes, 2), machines.w.tolist(), strict=True):
        m = sum(p * q for p, q in zip(x, w, strict=False)) + w[-1]
        margins[a, b], margins[b, a] = m, -m
        votes[a if m >= 0 else b] += 1
        votes[a] += np.tanh(m) * 1e-3
        votes[b] -= np.tanh(m) * 1e-3
    best = max(machines.classes, key=lambda c: votes[c])
    return best, 1 / (1 + np.exp(-4 * min(margins[best, c] for c in machines.classes if c != best))) if margins else 1.0


def test_language_equals_one_text_at_a_time(spark, sf):
    """The query against features, draw, split and votes in plain Python, on the query's own table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op2.query(spark, sf).collect()}
    model = op2.fit(docs.filter(op2.split("doc_id", 4) != 2))
    for d in docs.collect():
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if not d.text or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = plain_features(d.text)
        family, sure = plain_winner(model.top, x)
        lang, within = plain_winner(model.within[model.top.classes.index(family)], x)
        assert r.lang_pred == lang and abs(r.score - sure * within) < 1e-4
        assert op2.FAMILY_OF.get(lang, lang) == family


def test_machine_reaches_the_optimum():
    """The dual coordinate descent against gradient descent on the same loss."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 5)) + np.repeat([[0.6], [-0.6]], 30, axis=0)
    y = np.repeat([1.0, -1.0], 30)
    whole = np.hstack([x, np.ones((60, 1))])
    loss = lambda w: 0.5 * w @ w + (np.maximum(0, 1 - y * (whole @ w)) ** 2).sum()
    w = np.zeros(6)
    for _ in range(20000):
        w -= 1e-3 * (w - 2 * ((np.maximum(0, 1 - y * (whole @ w)) * y) @ whole))
    found = op2.fit_svm(x, y, cost=1.0, rounds=200)
    assert abs(loss(found) - loss(w)) < 1e-3 * loss(w)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op3.top_k(none, none, 5).count() == 0


def test_top_k_huge_components():
    code = np.array([[2**40, -(2**41)], [5, 7]], dtype=np.int64)
    found, score = op3.branch_and_bound([code.T.copy()], [np.zeros(2)], np.array([1, 2]), [np.array([3, 4])], 99, 5)
    assert score.tolist() == [43, 3 * 2**40 - 4 * 2**41] and found.tolist() == [1, 0]


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 100, "b": 1000, "c": 4000, "d": 10, None: 500, "": 0}
    got = {r.source: r.target for r in op5.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(names, itertools.cycle((5, 2, 1)), strict=False))
    left, budget, want = set(names), 1.5 * sum(sizes.values()), {}
    while True:  # share by weight; those above twice their size stop there; again
        total = sum(weight[s] for s in left)
        share = {s: budget * weight[s] / total for s in left}
        full = {s for s in left if share[s] >= 2 * sizes[s]}
        if not full:
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(want[s] for s in full)
        left -= full
    want |= share
    assert all(abs(got[s] - want[s]) < 1e-6 for s in names)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mix_comes_near_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice("abc") if i % 3 else "a") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, op5.mix(docs.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect())) for n in (1, 5))
    assert a == b and all(t in (0, s, 2 * s) for _, s, _, _, t in a)
    by_target = {}
    for _, _, size, target, taken in a:
        by_target.setdefault((size, target), []).append(taken)
    assert all(abs(sum(t) - target) <= 80 for (_, target), t in by_target.items())
    mixed = op5.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(t // s for _, s, _, _, t in a if s)


def test_mix_odd_tables(spark):
    docs = odd_documents(spark)
    got = op5.mix(docs).collect()
    assert len(got) == 14 and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4, 7)} == {0}
    assert op5.mixed(docs).columns == docs.columns
    assert op5.mix(no_documents(spark)).count() == 0
    empty = docs.filter("doc_id in (3, 4)")
    assert [r.taken for r in op5.mix(empty).collect()] == [0, 0]


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op8.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert n > 1000 and right / n > 0.95


def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if not words:
        return [0.0] * len(op8.NAMES)
    n, size, lengths = len(words), len(data), [len(w) for w in words]
    mean = sum(lengths) / n
    fives = [tuple(words[i : i + 5]) for i in range(n - 4)]
    lines = re.findall(rb"[^\n]*\n|[^\n]+$|$", data)
    lines = lines[:-1] if lines and lines[-1] == b"" and not data.endswith(b"\n") else lines
    upper, digit = len(re.findall(rb"[A-Z]", data)), len(re.findall(rb"[0-9]", data))
    letter = len(re.findall(rb"[A-Za-z\x80-\xff]", data))
    mark, plain = len(re.findall(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]", data)), len(re.findall(rb"[.,;:?'\"()-]", data))
    return [math.log1p(n), math.log(mean), math.log1p((sum((v - mean) ** 2 for v in lengths) / n) ** 0.5), len(set(words)) / n**0.8, (max(Counter(words).values()) / n) ** 0.5,
            (sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1)) ** 0.5 if n > 1 else 0.0, (1 - len(set(fives)) / len(fives)) ** 0.5 if fives else 0.0,
            (upper / max(letter, 1)) ** 0.5, (digit / size) ** 0.5, (mark / size) ** 0.5, (plain / size) ** 0.5, letter / size,
            math.log1p(len(lines)), (1 - len(set(lines)) / len(lines)) ** 0.5, (sum(w[-1:] in [bytes([c]) for c in b"!#$%&*+/<=>@[\\]^_`{|}~"] for w in words) / n) ** 0.5]


def test_quality_equals_one_text_at_a_time(spark, sf):
    """The query against statistics in plain Python and densities by determinant and solution of the covariances."""
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    x = {i: plain_statistics(t) for i, t in docs}
    learned = [i for i, _ in docs if i in labels and not out(i)]
    rows, y = np.array([x[i] for i in learned]), np.array([labels[i] for i in learned])
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    z, density = (rows - centre) / scale, []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own, rowvar=False)
        cov = (1 - op8.SHRINK) * cov + op8.SHRINK * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
        density.append((own.mean(axis=0), cov, np.linalg.slogdet(cov)[1]))
    prior = np.log(y.mean() / (1 - y.mean()))
    for r in op8.query(spark, sf).collect():
        own = (np.array(x[r.doc_id]) - centre) / scale
        one, two = (-0.5 * (own - m) @ np.linalg.solve(cov, own - m) - 0.5 * det for m, cov, det in density)
        want = 1 / (1 + np.exp(-np.clip(two - one + prior, -500, 500)))
        assert r.held_out == out(r.doc_id) and abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5)


def test_quality_odd_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 1), (8, 0), (8, 0), (4, None), (None, 1), (99, 1), (11, 7)], "doc_id long, quality int")
    for model in (op8.fit(docs, labels), op8.fit(docs, labels.filter("quality = 1")), op8.fit(docs, labels.filter("quality = 7"))):
        got = op8.classify(docs, model).collect()
        assert len(got) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert op8.fit(docs, labels.filter("quality = 7")).one == 0.5
    assert op8.classify(no_documents(spark), op8.fit(docs, labels)).count() == 0
    # Ids and labels that are repeated count once.
    once, often = op8.fit(docs.dropDuplicates(["doc_id"]), labels.distinct()), op8.fit(docs.dropDuplicates(["doc_id"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))), labels.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))), sample=20)
    assert once.share == often.share and [r.score for r in op8.classify(docs, once).orderBy("doc_id", "score").collect()] == pytest.approx([r.score for r in op8.classify(docs, often).orderBy("doc_id", "score").collect()])


def test_discriminant_parts_gaussians():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, len(op8.NAMES))), rng.normal(2, 0.3, (300, len(op8.NAMES)))])
    y = np.repeat([0, 1], 300)
    assert ((op8.Discriminant(x, y, 0.5).score(x) >= 0.5) == y).mean() > 0.99
