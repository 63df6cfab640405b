"""ZIP archives of candle files as a data source: a partition a member, whose lines are streamed as Arrow batches.

The driver lists archives and reads their directories, which stand at their ends; a task opens one member and decompresses it a block
at a time, so neither holds a file. Paths are those that pyarrow.fs opens (a plain path is a local or mounted one).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import candles

SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("value", pa.string())])
BLOCK = 1 << 20


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        store, root = _opened(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

        def members(name: str) -> list[Member]:
            with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                return [Member(name, x.filename) for x in archive.infolist() if not x.is_dir() and x.file_size]

        return [m for name in names for m in members(name)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = _opened(self.path)
        with store.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as stream:
            rest = b""
            while block := stream.read(BLOCK):
                *lines, rest = (rest + block).split(b"\n")
                if lines:
                    yield self._batch(partition, lines)
            if rest:
                yield self._batch(partition, [rest])

    @staticmethod
    def _batch(member: Member, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        values = [x.decode("utf-8", "replace").removesuffix("\r") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([member.archive.rsplit("/", 1)[-1]] * n), pa.array([member.name] * n), pa.array(values)], schema=SCHEMA)


class CandleArchives(DataSource):
    """archive, member, value: the lines of the members of all archives below a path."""

    @classmethod
    def name(cls) -> str:
        return "candle_archives"

    def schema(self) -> str:
        return "archive string, member string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CandleArchives)
    return spark.read.format("candle_archives").load(path)


def ingest(spark: SparkSession, path: str, interval: str) -> DataFrame:
    """Bars from archives named SYMBOL-..., by the rules of `candles.parsed`."""
    rows = lines(spark, path).select(F.regexp_extract("archive", "^([^-_.]+)[-_.]", 1).alias("symbol"), "value")
    return candles.parsed(rows, interval)
