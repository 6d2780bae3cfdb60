import hashlib
import random
import re

import pytest
from cases import no_documents, odd_documents

from tracespark.llm import op1_exact_dedup as op1
from tracespark.llm import op4_jaccard_join as op4
from tracespark.llm import op6_suffix_dedup as op6


def squeezed(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def expected_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0))
    return {s: (min(g)[2] if not min(g)[1] else None, len(g)) for s, g in groups.items()}


@pytest.mark.parametrize("hot", [64, 1])
def test_exact_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op1, "HOT_LEAST", hot)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "b", "", None, " ", "c d e", "cde"])) for i in range(120)] + [(200, "unique"), (None, "a  b")]
    got = op1.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("row").collect()
    want = expected_dedup(rows)
    by_sha = {hashlib.sha256(s.encode()).hexdigest(): v for s, v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_odd_tables(spark):
    got = op1.exact_dedup(odd_documents(spark)).select("doc_id", "kept", "keep_id", "group_size", "row.*").toPandas()
    assert len(got) == 14
    out = op1.exact_dedup(odd_documents(spark)).filter("kept").select("row.*")
    assert out.columns == odd_documents(spark).columns and out.count() == 10
    assert op1.exact_dedup(no_documents(spark)).count() == 0


def expected_links(rows):
    sets = [(i, t, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := re.findall("[^\x20\x09-\x0d]+", t or "")) else frozenset()) for i, t in rows]
    out = {}
    near = lambda a, b: (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    parent = {i: i for i, _, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t, a in sets:
        others = {u or "" for _, u, b in sets if near(a, b) and (u or "") != (t or "")}
        out[i] = len(others)
        for j, _, b in sets:
            if near(a, b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), n) for i, n in out.items()}


@pytest.mark.parametrize("leaf,block,hot", [(128, 256, 64), (8, 10, 1)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, leaf, block, hot):
    monkeypatch.setattr(op4, "LEAF", leaf)
    monkeypatch.setattr(op4, "HOT_LEAST", hot)
    monkeypatch.setattr(op4, "BLOCK", block)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(800)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(220):
        x = list(base) if i % 2 else [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((i, " ".join(x + base[:15] * (i % 7 == 0)) if i % 40 else rng.choice(["", None, "a b", " "])))
    got = {r.d: (r.class_id, r.n_links) for r in op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected_links(rows)


def test_jaccard_join_of_many_near_copies(spark):
    """One leaf of near copies, all linked: each has one word of 120 changed."""
    m = 5000
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(m)] + [(m, " ".join(reversed(base)))]
    got = op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("class_id", "n_links").count().collect()
    assert sorted(map(tuple, got)) == [(0, m - 1, m), (m, 0, 1)]


@pytest.mark.parametrize("hot", [1, 1000])
def test_components_of_hubs_and_chains(spark, monkeypatch, hot):
    monkeypatch.setattr(op4, "HOT_LEAST", hot)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 430)] + [(500, 299), (501, 500), (7, 7)]
    name = lambda i: i.to_bytes(2)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node): int.from_bytes(r.label) for r in op4.components(df).collect()}
    assert got == {i: 0 for i in [*range(300), 500, 501]} | {i: 400 for i in range(400, 431)}
    assert op4.components(df.limit(0)).count() == 0


def test_runs_reach_the_target():
    assert op4.runs_needed(1) <= op4.runs_needed(2) <= op4.runs_needed(3)
    assert op4.runs_needed(2, 0.9) < op4.runs_needed(2, 0.999)
    assert len(op4.roots()) == op4.runs_needed()


def test_jaccard_join_odd_tables(spark):
    docs = odd_documents(spark)
    got = op4.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.d: r for r in got}
    assert by_id[6].class_id == 5 and by_id[5].n_links == 1 and by_id[2].class_id == 1 and by_id[2].n_links == 0
    kept = op4.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 8, 9, 10, 11, 12, None}
    assert op4.near_duplicates(no_documents(spark)).count() == 0


def expected_spans(rows):
    """(id, bytes, removed, spans, kept) of each row: what a document of smaller id has, or the row itself earlier."""
    order = lambda i: 2**63 - 1 if i is None else i
    least, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for d, b in texts:
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            least[s] = min(order(d), least.get(s, order(d)))
    for d, b in texts:
        cover, seen = bytearray(len(b)), set()
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen or least[s] < order(d):
                cover[p : p + 100] = b"\1" * 100
            seen.add(s)
        out.append((d, len(b), sum(cover), sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1])), bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return sorted(out, key=repr)


def found_spans(spark, rows, parts=3):
    got = op6.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got], key=repr)


@pytest.mark.parametrize("hot,gather,bucket", [(65536, 200_000, 1 << 24), (1, 200_000, 1 << 24), (30, 300, 2000), (1, 1, 2000)])
def test_repeated_strings_against_brute_force(spark, monkeypatch, hot, gather, bucket):
    """All marks come from the construction, whatever of it runs in the first task."""
    monkeypatch.setattr(op6, "HOT", hot)
    monkeypatch.setattr(op6, "GATHER", gather)
    monkeypatch.setattr(op6, "BUCKET", bucket)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ijk") for _ in range(3000))
    rows = []
    for i in range(150):
        t = "".join(rng.choice("abcdefgh ijk") for _ in range(rng.randint(0, 300)))
        a, kind = rng.randint(0, 2500), rng.randrange(6)
        t = [t + base[:95] + t[::-1], t[:50] + base[200:340] + t[50:], base[a : a + rng.randint(90, 300)] + t, "ab" * rng.randint(1, 150) + t + "x" * rng.randint(0, 300), "é" * rng.randint(0, 120) + t, t][kind]
        rows.append((i * 7, t))
    assert found_spans(spark, rows) == expected_spans(rows)


def letters(rng, n):
    return "".join(rng.choice("abcdefgh ijk") for _ in range(n))


def colliding():
    """Two texts whose 16-bit remainders of CRC-32 agree: one with a repeated string, one without."""
    import zlib

    rng = random.Random(8)
    line = letters(rng, 120)
    one = line + letters(rng, 30) + line + letters(rng, 100)
    while True:
        two = letters(rng, 490)
        if zlib.crc32(two.encode()) % 65536 == zlib.crc32(one.encode()) % 65536:
            return one, two


def test_rows_of_one_id_are_told_apart(spark):
    one, two = colliding()
    rows = [(1, one), (1, two), (None, one[:300]), (None, two), (2, two[100:]), (1, one[:250])]
    assert found_spans(spark, rows) == expected_spans(rows)


def test_many_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(op6, "BUCKET", 100_000)
    rng = random.Random(9)
    shared = letters(rng, 140)
    rows = [(None, letters(rng, rng.randint(20, 200)) + (shared if i % 9 == 0 else "")) for i in range(10_000)] + [(None, shared)] * 700 + [(5, "x" + shared)]
    assert found_spans(spark, rows, 8) == expected_spans(rows)


def test_hot_string_over_many_gatherings(spark, monkeypatch):
    """A line of all documents, in gatherings of a few: each round sends on the earliest alone."""
    monkeypatch.setattr(op6, "HOT", 8)
    monkeypatch.setattr(op6, "GATHER", 20)
    monkeypatch.setattr(op6, "BUCKET", 3000)
    rng = random.Random(10)
    line = letters(rng, 130)
    rows = [(i, letters(rng, rng.randint(0, 150)) + line + letters(rng, rng.randint(0, 150))) for i in range(1, 600)]
    assert found_spans(spark, rows, 16) == expected_spans(rows)


def test_repeated_strings_odd_tables(spark):
    got = op6.repeated_spans(odd_documents(spark)).collect()
    assert len(got) == 14
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].n_bytes == 0 and by_id[1].spans == [] and by_id[2].kept == b""
    assert len(by_id[6].kept) < 110 and by_id[8].spans[0].asDict() == {"start": 1, "end": 5000}
    assert op6.repeated_spans(no_documents(spark)).count() == 0


def test_queries_return_their_columns(spark, sf):
    for m, columns in ((op1, "doc_id keep_id group_size kept text_sha256"), (op4, "doc_id class_id copy_id n_links"), (op6, "doc_id n_bytes n_removed n_spans kept_sha256")):
        df = m.query(spark, sf)
        assert df.columns == columns.split() and df.count() == 200


def test_column_construction_matches_direct_comparison():
    import numpy as np

    rng = np.random.default_rng(0)
    for m, alike in ((40, 10), (400, 7), (60, 60)):
        lo, hi = rng.integers(30, 77, m).astype(np.uint8), rng.integers(0, 30, m).astype(np.uint8)
        t = {"h": rng.integers(0, 3, m).astype(np.uint64), "doc": rng.integers(0, m, m), "k": np.zeros(m, np.int64), "q": np.full(m, 80, np.int32), "lo": lo, "hi": hi, "bytes": rng.integers(0, 2, (m, op6.COLUMNS)).astype(np.uint8)}
        for i in range(alike, m):
            cut, like = rng.integers(0, 30), i % alike
            t["bytes"][i, cut : cut + 140], t["h"][i] = t["bytes"][like, cut : cut + 140], t["h"][like]
            t["lo"][i], t["hi"][i] = t["lo"][like], t["hi"][like]
        j = np.arange(op6.COLUMNS)
        t["bytes"][(j < 76 - t["lo"].astype(int)[:, None]) | (j >= op6.COLUMNS - t["hi"].astype(int)[:, None])] = 0
        done, first = op6.columns(t), {}
        keys = {(i, j): (int(t["h"][i]), j, t["bytes"][i, j : j + 100].tobytes()) for i in range(m) for j in range(76 - t["lo"][i], 77 - t["hi"][i])}
        for (i, _), s in keys.items():
            first[s] = min(first.get(s, m), int(t["doc"][i]))
        want = {(i, j) for (i, j), s in keys.items() if first[s] < t["doc"][i]}
        assert set(zip(*map(np.ndarray.tolist, np.nonzero(done)), strict=True)) == want
        assert want or alike == m
        spans = op6.marks(t, done)
        assert {(int(d), p) for d, a, b in zip(spans["doc"], spans["start"], spans["end"], strict=True) for p in range(a, b - 99)} == {(int(t["doc"][i]), 4 + j) for i, j in want}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 5), (12, 11), (4, 20)]
    got = {r.node: r.label for r in op4.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 10: 10, 11: 10, 12: 10}
    assert op4.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_on_thousands_of_planted_links(spark):
    """4,000 pairs just at the threshold: 89 of 111 shingles shared, 0.8018. Every link is found, and none besides."""
    rng = random.Random(12)
    rows = []
    for i in range(4000):
        x = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join([*x[:93], *(f"v{rng.randrange(10**6)}" for _ in range(11))]))]
    got = op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("d", "class_id", "n_links").collect()
    assert sum(r.n_links for r in got) == 8000 and all(r.class_id == r.d - r.d % 2 and r.n_links == 1 for r in got)
