import random

import pytest

from tracespark.operators import correlate, queues


def machine(rows, most, timeout_s):
    """The state machine event by event."""
    names = [c.split()[0] for c in correlate.EVENT.split(", ")]
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    out = []
    for events in by_key.values():
        c = correlate.Connection(most, int(timeout_s * 1e9))
        for e in sorted(events, key=lambda e: (e["ts_ns"], e["seq"])):
            out += c.see(e)
        out += c.flush("in_flight")
    return sorted((tuple(correlate.finished_row(f).values()) for f in out), key=repr)


def traffic(seed, connections, n, weights=(10, 10, 1, 1), step=3):
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys(connections, 0)
    for i in range(n):
        c = connections[0] if rng.random() < 0.7 else rng.choice(connections)
        at[c] += rng.choice([0, 1, step, step, 40]) * 1_000_000_000
        rows.append((c, rng.choices(["request", "response", "open", "close"], weights)[0], at[c], i, f"s{i}", f"t{i % 50}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most,timeout_s,weights", [(3, 30, (10, 10, 1, 1)), (1, 1e6, (10, 6, 0, 0)), (1000, 35, (6, 10, 0.1, 0.1)), (5, 1e6, (10, 10, 0, 0))])
def test_replay_of_a_hot_connection(spark, most, timeout_s, weights):
    """Seven of ten events are of one connection, which lies on several tasks."""
    rows = traffic(most, ["hot", "a", "b", "zz", None], 3000, weights)
    df = spark.createDataFrame(rows, correlate.EVENT).repartition(5)
    got = sorted((tuple(r) for r in correlate.replay(df, most, timeout_s).collect()), key=repr)
    assert got == machine(rows, most, timeout_s)


def test_many_small_partitions_and_batches(spark):
    rows = traffic(9, [f"c{i}" for i in range(40)], 2500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, correlate.EVENT)
        dealt = queues.materialise(df.repartitionByRange(13, "conn_key", "ts_ns", "seq"))
        assert dealt.groupBy("conn_key").agg({"*": "count"}).count() == 40
        got = sorted((tuple(r) for r in correlate.replay(df, 4, 30).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == machine(rows, 4, 30)


def test_summaries_compose():
    """A slice's summary says what event by event comes to, from any start."""
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        most = rng.choice([1, 2, 5, 1000])
        kind = np.array([rng.randrange(4) for _ in range(rng.randint(1, 40))])
        by, low, high = queues.scanned(*queues.shifts(kind, most))
        for start in range(0, min(most, 8) + 1):
            n = start
            for i, k in enumerate(kind.tolist()):
                n = {queues.REQUEST: min(most, n + 1), queues.RESPONSE: max(0, n - 1)}.get(k, 0)
                assert n == min(high[i], max(low[i], start + by[i]))


def test_empty_table(spark):
    none = spark.createDataFrame([], correlate.EVENT)
    assert correlate.replay(none).count() == 0 and correlate.pairs(none).count() == 0 and correlate.orphans(none).count() == 0


def test_no_dict_for_a_row_and_no_task_for_a_connection(spark):
    """200,000 events of one connection in seconds, in all partitions."""
    df = spark.range(200_000).selectExpr("'one' AS conn_key", "if(id % 2 = 0, 'request', 'response') AS kind", "id * 1000 AS ts_ns", "id AS seq", "string(id) AS span_id", "'t' AS trace_id")
    found = correlate.replay(df)
    assert found.filter("parent_span_id IS NOT NULL AND duration_ms = 0.001").count() == 100_000 and found.count() == 200_000
