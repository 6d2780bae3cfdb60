import random
import time

import pytest
from pyspark.sql import functions as F

from tracespark import api
from tracespark.functions.scalars import fnv1a_64
from tracespark.operators import similarity, trees
from tracespark.operators.labels import Labels, function_of

COLUMNS = trees.COLUMNS


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_a_string_is_a_function_of_the_low_byte():
    rng = random.Random(1)
    for text in ("", " ", "svc:op[\n", "é日本\n", "x" * 300):
        factor, add = function_of(text.encode())
        for _ in range(20):
            h = want = rng.randrange(2**64)
            for b in text.encode():
                want = (want ^ b) * 0x100000001B3 % 2**64
            assert (h * int(factor) + int(add[h & 255])) % 2**64 == want


def forest(rng, n):
    """Trees of few names, so that many subtrees are equal; some spans have no parent that is there."""
    rows = []
    for t in range(n):
        for i in range(rng.choice([1, 2, 5, 30])):
            parent = None if i == 0 else f"{rng.choice([i - 1, rng.randrange(i)]):03}"
            rows.append((f"t{t:03}", f"{i:03}", "gone" if rng.random() < 0.02 else parent, rng.choice("ab"), rng.choice(["op", "öp"]), "HTTP", 1.0, rng.randrange(10**6)))
    return rows


def test_hashes_equal_those_of_the_texts(spark):
    df = spark.createDataFrame(forest(random.Random(2), 120), COLUMNS)
    got = trees.trees(df, structures=True, hashes=True).filter("in_tree").select("hash", fnv1a_64(F.col("structure")).alias("want"), "structure").collect()
    assert len(got) > 500 and all(r.hash == r.want == f"{fnv(r.structure):016x}" for r in got)


def test_occurrences_and_their_texts(spark):
    df = spark.createDataFrame(forest(random.Random(3), 60), COLUMNS)
    signed = similarity.signatures(trees.trees(df, structures=True))
    want = {r.structure: r["count"] for r in signed.groupBy("structure").count().collect()}
    found = similarity.occurrences(similarity.signatures(trees.trees(df, hashes=True)))
    got = similarity.spelt(df, found).collect()
    assert {r.structure: r["count"] for r in got} == want and len(got) == len(want) and max(want.values()) > 1


def test_labels_are_forgotten_beyond_a_bound(monkeypatch):
    from tracespark.operators import labels as module

    monkeypatch.setattr(module, "KEPT", 3)
    known = Labels()
    for k in (1, 2, 3, 1, 2):
        names, sizes, depths = [f"n{j}" for j in range(k)], list(range(k, 0, -1)), list(range(1, k + 1))
        text = lambda i: "".join("  " * (j - i) + f"n{j}" + ("[" if j < k - 1 else "") + "\n" for j in range(i, k)) + "".join("  " * (j - i) + "]\n" for j in range(k - 2, i - 1, -1))  # noqa: B023, E731
        assert [int(h) for h in known.of_tree(names, sizes, depths)] == [fnv(text(i)) for i in range(k)]


@pytest.mark.parametrize("shape,n", [("chain", 2000), ("chain", 16_000), ("bushy", 100_000)])
def test_large_traces_take_seconds(spark, shape, n):
    parent = "id - 1" if shape == "chain" else "(id - 1) div 5"
    df = spark.range(n).selectExpr("'t' AS trace_id", "lpad(id, 9, '0') AS span_id", f"if(id = 0, null, lpad({parent}, 9, '0')) AS parent_span_id", "concat('s', id % 7) AS service_name", "concat('op', id % 3) AS operation", "'HTTP' AS protocol", "1D AS duration_ms", "id AS start_ns")
    began = time.time()
    found = similarity.occurrences(similarity.signatures(trees.trees(df, hashes=True))).agg(F.sum("count"), F.count("hash")).first()
    assert found[0] == n and time.time() - began < 60
    if shape == "chain":
        assert found[1] == n


def test_deep_traces_have_an_answer():
    import json

    n = 100_000
    rows = [dict(trace_id="t", span_id=str(i), parent_span_id=str(i - 1) if i else "", start_ns=i, end_ns=i + 1) for i in range(n)]
    deep = api.assembled(rows)
    assert deep["parents"][:3] == [None, 0, 1] and "children" not in deep["root"] and json.dumps(deep["parents"])
    flat = api.assembled(rows[:150])
    level, tree = 0, flat["root"]
    while tree:
        level, tree = level + 1, (tree["children"] or [None])[0]
    assert level == 150 and "parents" not in flat and json.dumps(flat)


def test_shallow_trees_need_no_arrays(monkeypatch):
    """Trees of up to SHALLOW levels have the hashes of the walk in arrays, with more lines than are kept; deeper ones go by arrays."""
    from tracespark.operators import labels as module

    monkeypatch.setattr(module, "LINES", 3)
    rng, known = random.Random(4), Labels()
    for deepest in [1, 2, 3, 12] * 10:
        depths = [1]
        while len(depths) < 15 * deepest and deepest > 1:
            depths.append(rng.randint(2, min(deepest, depths[-1] + 1)))
        sizes = [next((j for j in range(i + 1, len(depths)) if depths[j] <= d), len(depths)) - i for i, d in enumerate(depths)]
        names = [rng.choice(["a:b", "é:日本", "svc:op", ""]) for _ in depths]
        want = [int(h) for h in known.walk(names, sizes, depths)]
        assert known.walk_shallow(names, sizes, depths) == want
        assert [int(h) for h in Labels().of_tree(names, sizes, depths)] == want
    assert len(known.whole) <= 3
    used = []
    monkeypatch.setattr(Labels, "walk", lambda *a: used.append("arrays") or [1] * len(a[1]))
    monkeypatch.setattr(Labels, "walk_shallow", lambda *a: used.append("whole") or [1] * len(a[1]))
    for n in (12, 13):
        Labels().of_tree(["a"] * n, list(range(n, 0, -1)), list(range(1, n + 1)))
    assert used == ["whole", "arrays"]
