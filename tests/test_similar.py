import random

import pytest
from pyspark.sql import functions as F

from tracespark.operators import similarity, trees
from tracespark.plans.views import spans


def ratio(a, b):
    shared = sum(x in a for x in b)
    return shared / (len(a) + len(b) - shared)


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.5])
def test_all_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    lists = [[rng.choice("abcdefghij"[: rng.choice([3, 6, 10])]) for _ in range(rng.randint(1, 12))] for _ in range(250)]
    signed = spark.createDataFrame([(f"h{i:03}", x) for i, x in enumerate(lists)], "hash string, operations array<string>")
    found = similarity.classes(signed).cache()
    pairs = similarity.similar_classes(found, threshold)
    plan = pairs._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    a, b = found.select(F.col("hash").alias("x"), "set_id"), found.select(F.col("hash").alias("y"), "bag_id")
    got = {(r.x, r.y): round(r.similarity, 9) for r in pairs.join(a, "set_id").join(b, "bag_id").collect()}
    want = {(f"h{i:03}", f"h{j:03}"): round(s, 9) for i, x in enumerate(lists) for j, y in enumerate(lists) if (s := ratio(set(x), y)) >= threshold}
    assert got == want and len(want) > 50
    assert similarity.similar_classes(similarity.classes(signed.limit(0))).count() == 0


def test_spelt_whole_where_joins_turn_into_broadcasts(spark, sf):
    """Joins by trace that are planned as sorted and run as broadcasts leave no trace cut."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        made = spans(spark, sf)
        found = similarity.occurrences(similarity.signatures(trees.trees(made, hashes=True)), True)
        got = {r.structure: r["count"] for r in similarity.spelt(made, found).collect()}
    finally:
        for k in changed:
            spark.conf.unset(k)
    want = similarity.signatures(trees.trees(made, structures=True)).groupBy("structure").count().filter("count > 1").collect()
    assert got == {r.structure: r["count"] for r in want} and len(got) > 100


def test_similar_to_one_spells_no_text_and_sorts_nothing(spark, sf):
    """The registered query: no text of subtrees, no aggregate that sorts; the operations of the one may be given."""
    from tracespark.plans import registry

    plan = registry.queries()["CMP07_similar_signatures"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    signed = spark.createDataFrame([("x", ["a", "b"], 2), ("y", ["b", "a"], 2), ("y", ["b", "a"], 3), ("z", ["c"], 1)], "hash string, operations array<string>, depth int")
    one = signed.filter("hash = 'x'").first()
    got = [tuple(r) for r in similarity.similar(signed, "x", 0.6, one).select("hash", "depth", "similarity").collect()]
    assert got == [("y", 3, 1.0)] == [tuple(r) for r in similarity.similar(signed, "x", 0.6).select("hash", "depth", "similarity").collect()]
    assert similarity.similar(signed, "w").collect() == []
    assert "SortAggregate" not in similarity.classes(signed)._jdf.queryExecution().executedPlan().toString() and similarity.classes(signed).count() == 3
