from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracespark.plans import views
from tracespark.sources import tables, upkeep


@pytest.fixture
def spans(spark, sf):
    return views.latencies(spark, sf).limit(600).withColumns({"payload": F.lit("x"), "end_time": F.col("start_time")}).cache()


def ids(df):
    return sorted(r.span_id for r in df.select("span_id").collect())


def folders(path):
    return sorted(p.name for p in path.glob("month=*/batch=*"))


def test_batches_of_either_kind_become_one_folder_a_month(spark, spans, tmp_path):
    path, where = str(tmp_path / "t"), tmp_path / "t"
    for i in range(12):
        tables.write_spans(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(13)) == i), path, batch=i)
    tables.write_spans(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(13)) == 12), path)
    want, months = ids(spans), len(list(where.glob("month=*")))
    assert ids(tables.read_spans(spark, path)) == want
    before = len(folders(where))
    done = upkeep.compact(spark, path, newest=2)
    assert done > 5 and ids(tables.read_spans(spark, path)) == want  # covered folders are still there
    assert len(folders(where)) > before
    assert upkeep.compact(spark, path, newest=2) == 0 and ids(tables.read_spans(spark, path)) == want
    assert len(folders(where)) <= months * 3 and {10, 11} <= {upkeep.batch_of(f) for f in folders(where)}
    tables.write_spans(spans.limit(5), path, batch=12)
    upkeep.compact(spark, path, newest=0)
    upkeep.compact(spark, path, newest=0)
    assert len(folders(where)) == months and tables.read_spans(spark, path).count() == len(want) + 5
    assert len(list(where.glob("month=*/batch=*/*.parquet"))) == months
    assert tables.read_spans(spark, path, start="2100-01-01").count() == 0


@pytest.mark.parametrize("at", ["written", "renamed"])
def test_a_run_that_breaks_off_leaves_each_row_once(spark, spans, tmp_path, monkeypatch, at):
    path = str(tmp_path / "t")
    for i in range(3):
        tables.write_spans(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(3)) == i), path, batch=i)
    write = upkeep.Folder.write

    def broken(self, lines):
        if at == "renamed":
            write(self, lines)
        raise KeyboardInterrupt

    monkeypatch.setattr(upkeep.Folder, "write", broken)
    with pytest.raises(KeyboardInterrupt):
        upkeep.compact(spark, path, newest=0)
    monkeypatch.undo()
    assert ids(tables.read_spans(spark, path)) == ids(spans)
    upkeep.compact(spark, path, newest=0)
    tables.write_spans(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(3)) == 1), path, batch=1)  # a late repeat of a covered batch
    assert ids(tables.read_spans(spark, path)) == ids(spans)
    assert not (tmp_path / "t" / upkeep.WORK).exists()


def test_expired_months_go(spark, spans, tmp_path):
    path = str(tmp_path / "t")
    old = spans.withColumn("start_time", F.lit("2023-11-30 23:00:00").cast("timestamp"))
    new = spans.withColumn("start_time", F.lit("2023-12-01 01:00:00").cast("timestamp"))
    tables.write_spans(old, path)
    tables.write_spans(new, path)
    at = lambda text: datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    assert upkeep.drop_expired(spark, path, 30, at("2023-12-30")) == []
    assert upkeep.drop_expired(spark, path, 30, at("2023-12-31")) == ["month=202311"]
    assert tables.read_spans(spark, path).count() == 600 and not (tmp_path / "t" / "month=202311").exists()
    assert upkeep.expired(["month=202312"], 1, at("2024-01-02")) == ["month=202312"]
    assert upkeep.drop_expired(spark, str(tmp_path / "none"), 1) == []
