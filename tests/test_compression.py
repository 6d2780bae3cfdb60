import json
import math

import pyarrow as pa
import zstandard

from tracespark.operators import similarity

SCHEMA = "k long, text string, x double, n int, ok boolean"
ROWS = [(1, "é\n\"\\/ 😀" * 60, 0.1, 5, True), (2, "", -1e300, None, None), (3, None, math.inf, -7, False), (4, "a" * 300, None, 2**31 - 1, True), (5, "ab" * 200, 20.0, 0, False)]


def rows(spark):
    return spark.createDataFrame([(f"t{k}", f"s{k}", k, *r) for k, *r in ROWS], f"trace_id string, span_id string, {SCHEMA}").coalesce(1)


def test_packed_as_one_by_one(spark):
    """A batch is compressed in one call, to the same bytes and sizes as text by text."""
    spans = rows(spark)
    texts = [r.j.encode() for r in spans.selectExpr("to_json(struct(*)) AS j").collect()]
    z = zstandard.ZstdCompressor(level=similarity.LEVEL)
    assert similarity.packed_texts(z, pa.array([b"before", *texts], pa.binary()).slice(1)) == [z.compress(t) for t in texts]
    assert similarity.packed_texts(z, pa.array([], pa.binary())) == []
    for r, t in zip(similarity.compress(spans).collect(), texts, strict=True):
        small = z.compress(t)
        good = len(t) >= 256 and len(t) / len(small) >= 1.2
        assert (r.is_compressed, r.original_size, r.compressed_size, bytes(r.data)) == (good, len(t), len(small) if good else len(t), small if good else t)
        assert r.ratio == (len(t) / len(small) if good else 1.0)
    assert similarity.compress(spans.limit(0)).count() == 0


def test_back_as_from_json_reads_it(spark):
    """Plain batches are read by Arrow; one with an infinite number, other types or a field that isn't of its type is
    left to from_json."""
    packed = similarity.compress(rows(spark))
    assert [tuple(r) for r in similarity.decompress(packed, SCHEMA).orderBy("k").collect()] == ROWS
    finite = similarity.compress(rows(spark).filter("k <> 3"))
    assert [tuple(r) for r in similarity.decompress(finite, SCHEMA).orderBy("k").collect()] == [r for r in ROWS if r[0] != 3]
    assert [r.k for r in similarity.decompress(packed, "k string").orderBy("k").collect()] == list("12345")
    assert [r.k for r in similarity.decompress(packed, "k decimal(5,1)").orderBy("k").collect()] == [1, 2, 3, 4, 5]
    assert [r.text for r in similarity.decompress(packed, "text int").collect()] == [None] * 5


def test_fields_that_arrow_takes():
    wanted = pa.schema([("k", pa.int64()), ("x", pa.float64())])
    read = lambda *texts: similarity.plain_rows([t if isinstance(t, bytes) else json.dumps(t).encode() for t in texts], wanted)
    assert read({"x": 2, "more": [{"k": 1}]}, {"k": 3}).to_pylist() == [{"k": None, "x": 2.0}, {"k": 3, "x": None}]
    for bad in (b"", b"[1]", b"{", b'{"k":1}{"k":2}', b'{"k":1.5}', b'{"x":"NaN"}', b'{"k":"1"}'):
        assert read(bad) is None and read({"k": 1}, bad) is None
