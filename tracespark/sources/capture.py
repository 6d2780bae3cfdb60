"""Capture files as a data source: fixed-size records, split on their boundaries, followed as files grow.

A file of any size is read in splits of whole records by as many tasks, each a batch at a time; a stream's offset says how many
records of each file have been read, so it goes on in the middle of a file. Folders are listed with Arrow's
file systems (local, HDFS, S3, GCS); for stores that only Spark's readers open, raw.read_records remains.

Defined cases: a remainder shorter than a record waits until it is whole; empty files and folders have no rows; files
that were removed are forgotten; a file that has become shorter is not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import RAW_SIZE

NAME = "captures"
SCHEMA = "file string, record_nr long, record binary"
ARROW = pa.schema([("file", pa.string()), ("record_nr", pa.int64()), ("record", pa.binary())])
#: Bytes of a split and of a batch.
SPLIT, BATCH = 64 << 20, 4 << 20


class Split(InputPartition):
    """Some successive records of a file."""

    def __init__(self, file: str, first: int, end: int):
        self.file, self.first, self.end = file, first, end


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """How many whole records each file under a path has."""
    where, at = store(path)
    info = where.get_file_info(at)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {f.path: f.size // RAW_SIZE for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def splits(begin: dict[str, int], end: dict[str, int], size: int) -> list[Split]:
    """The records of each file between two counts, in splits of at most `size` bytes."""
    step = max(1, size // RAW_SIZE)
    return [Split(f, i, min(n, i + step)) for f, n in sorted(end.items()) for i in range(begin.get(f, 0), n, step)]


def records(path: str, part: Split) -> Iterator[pa.RecordBatch]:
    where, _ = store(path)
    step = max(1, BATCH // RAW_SIZE)
    with where.open_input_file(part.file) as source:
        for i in range(part.first, part.end, step):
            n = min(part.end, i + step) - i
            data = source.read_at(n * RAW_SIZE, i * RAW_SIZE)
            at = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * RAW_SIZE)
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(np.arange(i, i + n)), pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(data)])], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Split]:
        return splits({}, listed(self.path), self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition) if isinstance(partition, Split) else iter(())


class StreamReader(DataSourceStreamReader):
    """An offset is the number of records read of each file."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.path)

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits(start, end, self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema) -> Reader:
        return Reader(*self._options())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._options())


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """SRC-11: the records of all capture files under a path, as raw.read_records gives them."""
    spark.dataSource.register(Captures)
    return spark.read.format(NAME).option("path", path).option("splitBytes", split_bytes).load()


def stream_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """SRC-10: the records as they arrive, in new files or at the end of known ones."""
    spark.dataSource.register(Captures)
    return spark.readStream.format(NAME).option("path", path).option("splitBytes", split_bytes).load()
