import bisect

from pyspark.sql import functions as F

from tracespark.operators import stats


def test_merged_quantiles_are_within_the_stated_rank(spark):
    """300,000 durations of one group: minutes to hours to a day, against their exact ranks."""
    spans = spark.range(300_000).select((F.col("id") * 250_000_000).alias("start_ns"), F.lit("s").alias("service_name"), F.lit("o").alias("operation"), F.lit("HTTP").alias("protocol"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("duration_ms"), F.lit(0).alias("error_code"), F.lit(1).cast("long").alias("payload_size"))
    day = stats.merged_stats(stats.merged_stats(stats.sketched_rollup(spans)), 86_400_000_000)
    rows = day.collect()
    values = sorted(r.duration_ms for r in spans.select("duration_ms").collect())
    assert len(rows) == 1 and rows[0].call_count == 300_000 and len(rows[0].durations) < 20_000
    for name, p in stats.SKETCHED:
        rank = bisect.bisect_right(values, rows[0][f"{name}_duration_ms"]) / len(values)
        assert abs(rank - p) <= stats.rank_error()


def test_small_groups_are_exact_and_sketches_optional(spark, sf):
    from tracespark.plans import views

    spans = views.latencies(spark, sf)
    merged = stats.merged_stats(stats.sketched_rollup(spans), 86_400_000_000)
    want = {tuple(r)[:2]: r.q for r in spans.groupBy(F.expr("start_ns div 1000 - pmod(start_ns div 1000, 86400000000)").alias("period_us"), "operation").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_ms)").alias("q")).collect()}
    assert {(r.period_us, r.operation): r.p90_duration_ms for r in merged.collect()} == want
    assert "durations" not in stats.merged_stats(stats.stats_rollup(spans)).columns


def test_sorted_quantiles_equal_percentiles(spark):
    """A hot group of few and many different values, small ones, null keys, nulls and groups of nulls alone."""
    rows = spark.range(20_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'k' || id % 97 END").alias("a"), F.expr("id % 2").alias("b"), F.expr("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN 7.0 ELSE pmod(xxhash64(id), 100003) / 16 END").alias("x"))
    rows = rows.unionByName(spark.sql("SELECT 'none' AS a, 1L AS b, CAST(NULL AS DOUBLE) AS x UNION ALL SELECT 'one', 1L, 5.0 UNION ALL SELECT 'nan', 1L, double('NaN')"))
    quantiles = (("low", 0.0), ("half", 0.5), ("most", 0.99), ("top", 1.0))
    got = {(r.a, r.b): r for r in stats.sorted_quantiles(rows, ["a", "b"], *quantiles, column="x").collect()}
    want = rows.groupBy("a", "b").agg(F.count("x").alias("n"), *[F.percentile("x", p).alias(f"{name}_x") for name, p in quantiles]).filter("n > 0").collect()
    assert len(got) == len(want) and ("none", 1) not in got and (None, 0) in got
    for r in want:
        assert got[r.a, r.b].n == r.n and all(repr(got[r.a, r.b][f"{name}_x"]) == repr(r[f"{name}_x"]) or abs(got[r.a, r.b][f"{name}_x"] - r[f"{name}_x"]) < 1e-9 for name, _ in quantiles)
    assert stats.sorted_quantiles(rows.limit(0), ["a"], ("half", 0.5), column="x").collect() == []


def test_merged_counts_are_exact_beyond_a_sketch(spark):
    """5,000 values of one day, a period of two values, and one without durations: the query's steps against sorted lists."""
    spans = spark.range(5_003).select(F.expr("CASE WHEN id < 5000 THEN id * 17000000000 ELSE (id - 4999) * 86400000000000 * 2 END").alias("start_ns"), F.lit("s").alias("service_name"), F.lit("o").alias("operation"), F.lit(None).cast("string").alias("protocol"), F.expr("CASE WHEN id = 5002 OR id % 50 = 7 AND id < 5000 THEN NULL ELSE pmod(xxhash64(id), 100003) / 16 END").alias("duration_ms"))
    spans = spans.unionByName(spans.filter("start_ns = 172800000000000"))
    day = stats.merged_counts(stats.merged_counts(stats.counted_rollup(spans)), 86_400_000_000)
    held: dict[int, list] = {}
    for r in spans.collect():
        held.setdefault(r.start_ns // 86_400_000_000_000 * 86_400_000_000, []).append(r.duration_ms)
    rows = {r.period_us: r for r in stats.counted_quantiles(day, *stats.SKETCHED).collect()}
    assert rows.keys() == held.keys() and max(map(len, held.values())) > stats.SKETCH
    for period, values in held.items():
        values, r = sorted(v for v in values if v is not None), rows[period]
        assert r.call_count == len(held[period])
        for name, p in stats.SKETCHED:
            assert r[f"{name}_duration_ms"] == (values[max(0, -(-len(values) * round(p * 100) // 100) - 1)] if values else None)


def test_query_of_merged_quantiles_is_exact_on_more_calls(spark, sf, tmp_path):
    """Days of more calls than a sketch holds, against the query's SQL."""
    import duckdb

    from tracespark.plans import registry

    more = spark.read.parquet(f"{sf}/events.parquet").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(400)))).withColumns({"event_id": F.expr("event_id * 400 + i"), "value": F.expr("value + pmod(xxhash64(event_id, i), 10007) / 100")}).drop("i")
    more.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(registry.oracle_sql()["AGG06_merged_quantiles"])
    columns = [c[0] for c in cursor.description]
    got = registry.queries()["AGG06_merged_quantiles"](spark, str(tmp_path)).select(*columns).collect()
    want = cursor.fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and max(r[columns.index("call_count")] for r in want) > 800
