import duckdb
import pytest
from cases import no_documents, odd_documents

import corpus_pipeline
from tracespark.llm import op1_exact_dedup, op5_mixing, registry

TABLES = "documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf, con, name):
    got = sorted(map(tuple, registry.queries()[name](spark, sf).collect()), key=str)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert columns == registry.queries()[name](spark, sf).columns
    want = sorted(cursor.fetchall(), key=str)
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want]


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == columns, name
            docs = out
        counts.append(out.count())
    n = op1_exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).filter("kept").count()
    assert counts[0] == counts[1] == 200 and counts[2] == n and counts[3] <= n
    assert counts[4] == counts[5] == op5_mixing.mix(near(spark, sf)).agg({"copies": "sum"}).first()[0]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, out.collect()))


def test_stages_of_odd_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows and columns of clashing names go through every stage."""
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for input_ in (docs, no_documents(spark)):
            out = stage(spark, input_, sf)
            assert name == "tokens" or out.columns == input_.columns
            if input_ is docs:
                kept, texts = out, {r.text for r in docs.collect()}
            else:
                assert out.count() == 0
        if name == "tokens":
            assert kept.count() == docs.count()
        else:
            docs = spark.createDataFrame(kept.collect(), kept.schema)
            assert docs.count() > 0 and {r.text for r in docs.collect()} <= texts
    assert {r.doc_id for r in docs.collect()} >= {1, 5, 8, 10}


def near(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    return docs
