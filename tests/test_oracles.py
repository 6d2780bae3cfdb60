import datetime
import decimal

import duckdb
import pytest

from tracespark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6) + 0.0
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_have_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).limit(1).count() >= 0
