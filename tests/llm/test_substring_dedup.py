import random

import duckdb
import pytest
from cases import no_documents, odd_documents, prose

from tracespark.llm import common
from tracespark.llm import op13_substring_dedup as op13


def expected(rows):
    """(n_words, spans, kept) of each row, from all windows as tuples of words."""
    order = lambda i: 2**63 - 1 if i is None else i
    texts = [(order(i), (t or "").encode().split()) for i, t in rows]
    least = {}
    for o, w in texts:
        for p in range(len(w) - op13.WINDOW + 1):
            key = tuple(w[p : p + op13.WINDOW])
            least[key] = min(o, least.get(key, o))
    out = []
    for o, w in texts:
        gone = set()
        for p in range(len(w) - op13.WINDOW + 1):
            if least[tuple(w[p : p + op13.WINDOW])] < o:
                gone.update(range(p, p + op13.WINDOW))
        out.append((len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


def found(spark, rows):
    got = op13.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got]


def check(spark, rows):
    want = sorted([(i, *e) for (i, _), e in zip(rows, expected(rows), strict=True)], key=repr)
    assert sorted(found(spark, rows), key=repr) == want


def passages(seed, n=150):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (49, 50, 51, 60, 120, 400)]
    hot = prose(rng, 75)
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.choice([0, 3, 20, 90])), rng.choice(shared), prose(rng, rng.choice([0, 10, 70]))]
        if i % 3 == 0:
            parts.insert(1, hot)
        if i % 10 == 0:  # a passage twice in one document
            parts.append(parts[1])
        rows.append((i, rng.choice(["  ", "\n", " \t"]).join(parts)))
    return rows + [(7, rows[7][1]), (7, rows[3][1]), (None, rows[5][1]), (None, rows[6][1]), (None, hot)]


def test_against_brute_force(spark):
    check(spark, passages(1))


def test_hot_windows_and_small_units(spark, monkeypatch):
    monkeypatch.setattr(op13, "HOT", 3)
    monkeypatch.setattr(op13, "BUCKET", 4000)
    monkeypatch.setattr(op13, "GATHER", 50)
    monkeypatch.setattr(op13, "LOAD", 100)
    check(spark, passages(2, 90))


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With hardly a cell, every window is estimated repeated; the result is the same."""
    monkeypatch.setattr(op13, "BITS", 2)
    check(spark, passages(3, 60))


def test_repetition_within_a_document_stays(spark):
    line = prose(random.Random(4), 60)
    check(spark, [(1, f"{line} {line} {line}"), (2, "short"), (3, f"x {line} y")])


def test_many_equal_rows_without_id(spark):
    text = prose(random.Random(5), 80)
    rows = [(None, text)] * 500 + [(1, text)] + [(2, "a b c"), (None, None), (3, f"{text} more")]
    check(spark, rows)
    assert common.collapsed(spark.createDataFrame([(1, "a")] * 300 + [(2, "b")], "doc long, text string"), ["doc"], "text")[0].count() == 2


def test_odd_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    got = op13.repeated_windows(odd_documents(spark)).collect()
    assert sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got], key=repr) == sorted([(i, *e) for (i, _), e in zip(rows, expected(rows), strict=True)], key=repr)
    assert op13.repeated_windows(no_documents(spark)).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_equals_sql(spark, scale):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{scale}/documents.parquet'")
    cursor = con.execute(op13.ORACLE)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = op13.query(spark, f"/root/testdata/{scale}").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_removed for r in got) > 0
