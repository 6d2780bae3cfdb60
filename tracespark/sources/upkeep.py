"""Upkeep of span tables: small batch folders become a few files a month, expired months go.

A table is folders month=yyyyMM/batch=N. `compact` writes what a month's folders hold to one folder beside them,
under a name that readers pass over, with the list of folders that it covers, and renames it into place; from
then on readers see it and not what it covers. Covered folders are deleted by the next run, so readers that listed
them can end. The newest numbered batches are left alone, as a stream may write these again.

Needs a store that renames a folder in one step (local, HDFS); one compaction of a table may run at a time. A
run that ends anywhere leaves the table readable, each row once; the next one clears what it left.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

#: The file in a compacted folder that names what it covers, and the folder for work in progress.
COVERS, WORK = "_covers", "_compacting"
#: Numbered batches that compaction leaves alone, and bytes of a file that it writes.
NEWEST, FILE_BYTES = 10, 256 << 20


class Folder:
    """A path in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def names(self, prefix: str) -> list[str]:
        """Folders in it whose names begin so, sorted."""
        found = self.fs.listStatus(self.path) if self.exists() else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(prefix))

    def bytes(self) -> int:
        return self.fs.getContentSummary(self.path).getLength()

    def read(self) -> list[str]:
        if not self.exists():
            return []
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def write(self, lines: list[str]) -> None:
        stream = self.fs.create(self.path, True)
        try:
            stream.write(bytearray("\n".join(lines).encode()))
        finally:
            stream.close()

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def batch_of(name: str) -> int:
    return int(name.partition("=")[2])


def unnumbered() -> int:
    """A number for a batch that has none: negative, so that it is no stream's."""
    return -time.time_ns()


def covered(month: Folder) -> tuple[list[str], set[str]]:
    """A month's batch folders, and those of them that others cover."""
    names = month.names("batch=")
    return names, {c for n in names if batch_of(n) < 0 for c in month.of(f"{n}/{COVERS}").read()}


def live(spark: SparkSession, path: str) -> list[str] | None:
    """The folders that readers should read; None where that is all of them."""
    table = Folder(spark, path)
    found, hidden = [], False
    for m in table.names("month="):
        names, gone = covered(table.of(m))
        hidden |= bool(gone & set(names))
        found += [f"{path}/{m}/{n}" for n in names if n not in gone]
    return found if hidden else None


def read_live(spark: SparkSession, path: str) -> DataFrame:
    folders = live(spark, path)
    return spark.read.parquet(path) if folders is None else spark.read.option("basePath", path).parquet(*folders)


def compact(spark: SparkSession, path: str, newest: int = NEWEST, file_bytes: int = FILE_BYTES) -> int:
    """SNK-02: months of several folders to one folder of few files; returns how many folders were covered. Folders covered by
    an earlier run are deleted first."""
    table, done = Folder(spark, path), 0
    table.of(WORK).delete()
    months = table.names("month=")
    numbered = sorted({batch_of(n) for m in months for n in table.of(m).names("batch=") if batch_of(n) >= 0})
    left_alone = set(numbered[len(numbered) - newest :]) if newest else set()
    for m in months:
        month = table.of(m)
        names, gone = covered(month)
        for n in gone & set(names):
            month.of(n).delete()
        merge = [n for n in names if n not in gone and batch_of(n) not in left_alone]
        if len(merge) < 2:
            continue
        made, size = f"batch={unnumbered()}", sum(month.of(n).bytes() for n in merge)
        rows = spark.read.parquet(*[f"{path}/{m}/{n}" for n in merge])
        order = ["start_time", "trace_id", "span_id"]
        work = table.of(f"{WORK}/{m}-{made}")
        rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order).write.option("compression", "zstd").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(str(work.path))
        work.of(COVERS).write(merge)
        if not work.fs.rename(work.path, month.of(made).path):
            raise OSError(f"{work.path} can't be renamed")
        done += len(merge)
    table.of(WORK).delete()
    return done


def expired(months: list[str], days: int, now: datetime) -> list[str]:
    """Of folders month=yyyyMM those whose last moment is more than so many days ago."""
    out = []
    for m in months:
        year, month = int(m[-6:-2]), int(m[-2:])
        end = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=timezone.utc)
        if (now - end).total_seconds() >= days * 86_400:
            out.append(m)
    return out


def drop_expired(spark: SparkSession, path: str, days: int, now: datetime | None = None) -> list[str]:
    """SNK-06: deletes the months that a time to live of so many days leaves nothing of; returns their names. Rows that have
    expired in other months are left to tables.retained."""
    table = Folder(spark, path)
    gone = expired(table.names("month="), days, now or datetime.now(timezone.utc))
    for m in gone:
        table.of(m).delete()
    return gone
