"""Joins and sorts of large tables: as many tasks as rows ask for, whatever the session's number of partitions."""

import duckdb

from tracespark.operators import folds
from tracespark.plans import registry
from tracespark.plans.views import spans


def plain(rows):
    return sorted(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows)


def equals_sql_when_spread(spark, sf, monkeypatch, name, rows):
    """The query with 500 rows to a task: its tasks follow the number of rows, though the session has 4, and it equals the SQL."""
    monkeypatch.setattr(folds, "ROWS", 500)
    df = registry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    assert plain(df.select(*[c[0] for c in cursor.description]).collect()) == plain(cursor.fetchall())


def test_orphans(spark, sf, monkeypatch):
    equals_sql_when_spread(spark, sf, monkeypatch, "JN02_orphans", spans(spark, sf).filter("duration_ms > 100").count())


def test_view(spark, sf, monkeypatch):
    equals_sql_when_spread(spark, sf, monkeypatch, "FLT04_non_roots", spark.read.parquet(f"{sf}/lineitem.parquet").count())


def test_small_tables_are_left_to_spark(spark, sf):
    assert folds.tasks_of(spans(spark, sf)) == 0
    assert "REPARTITION_BY_NUM" not in registry.queries()["JN02_orphans"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_forced_traces(spark, sf, monkeypatch):
    equals_sql_when_spread(spark, sf, monkeypatch, "SMP06_forced_traces", spans(spark, sf).count())


def test_service_map(spark, sf, monkeypatch):
    equals_sql_when_spread(spark, sf, monkeypatch, "AGG02_service_map", spans(spark, sf).count())
