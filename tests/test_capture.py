import random

from tracespark.schema import RAW_SIZE
from tracespark.sources import capture, raw


def written(path, n, seed=1, mode="wb"):
    data = random.Random(seed).randbytes(n * RAW_SIZE)
    with open(path, mode) as f:
        f.write(data)
    return [data[i : i + RAW_SIZE] for i in range(0, len(data), RAW_SIZE)]


def test_a_file_of_several_splits(spark, tmp_path):
    want = {("a.bin", i): r for i, r in enumerate(written(tmp_path / "a.bin", 103))}
    (tmp_path / "deeper").mkdir()
    want |= {("b.bin", i): r for i, r in enumerate(written(tmp_path / "deeper" / "b.bin", 5, 2))}
    with open(tmp_path / "a.bin", "ab") as f:
        f.write(b"rest")
    (tmp_path / "empty.bin").touch()
    written(tmp_path / "_hidden", 3)
    df = capture.read_captures(spark, str(tmp_path), 10 * RAW_SIZE)
    assert df.rdd.getNumPartitions() == 12
    assert {(r.file.split("/")[-1], r.record_nr): bytes(r.record) for r in df.collect()} == want


def test_equal_to_whole_files(spark, tmp_path):
    written(tmp_path / "a.bin", 50, 3)
    plain = lambda df: sorted((r.file.removeprefix("file:"), r.record_nr, bytes(r.record)) for r in df.collect())
    assert plain(capture.read_captures(spark, str(tmp_path), 1)) == plain(raw.read_records(spark, str(tmp_path)))
    assert capture.read_captures(spark, f"file://{tmp_path}").count() == 50
    assert raw.events(capture.read_captures(spark, str(tmp_path))).count() == 50


def test_no_file(spark, tmp_path):
    assert capture.read_captures(spark, str(tmp_path)).count() == 0


def test_a_stream_goes_on_in_mid_file(spark, tmp_path):
    """A file grows between runs, once in the middle of a record; each record comes once."""
    (tmp_path / "in").mkdir()
    file, want = tmp_path / "in" / "a.bin", []

    def run():
        stream = capture.stream_captures(spark, str(tmp_path / "in"), 4 * RAW_SIZE)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file.split("/")[-1], r.record_nr, bytes(r.record)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want += written(file, 9)
    assert [r for *_, r in run()] == want
    more = written(tmp_path / "more", 6, 5)
    data = b"".join(more)
    with open(file, "ab") as f:
        f.write(data[: 2 * RAW_SIZE + 700])
    assert [r for *_, r in run()] == want + more[:2]
    with open(file, "ab") as f:
        f.write(data[2 * RAW_SIZE + 700 :])
    other = written(tmp_path / "in" / "b.bin", 3, 6)
    assert [r for *_, r in run()] == want + more + other and [n for f, n, _ in run() if f == "a.bin"] == list(range(15))


def test_records_made_of_columns_are_made_once(spark, sf):
    """No filter on the record's length below the decoder, which would have Spark encode each record twice; long records
    are cut and short ones and nulls dropped."""
    from tracespark.functions import codec
    from tracespark.plans.views import raw_records

    made = raw_records(spark, sf)
    assert "Filter" not in codec.decode(made)._jdf.queryExecution().optimizedPlan().toString()
    one = bytes(made.orderBy("event_id").first().record)
    assert len(one) == codec.RAW_SIZE
    given = spark.createDataFrame([(1, bytearray(one[:-1])), (2, bytearray(one + b"more")), (3, None), (4, bytearray(one)), (5, bytearray())], "id long, record binary").coalesce(1)
    rows = [r.asDict() for r in codec.decode(given).orderBy("id").collect()]
    assert [r.pop("id") for r in rows] == [2, 4] and rows[0] == rows[1]
