"""Zip archives of text as a data source: one partition per member, unpacked piece by piece.

``binaryFile`` holds a whole archive in one row, which ends at two gigabytes and at the memory of a task. Here the driver
reads only the archives' directories; each task opens its archive at its own member and inflates it as lines are
taken, so memory is bounded by a batch of lines. Paths may be in any store that Arrow's file systems reach (local,
HDFS, object stores); for others there is ``parsers.unzip_lines``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, member string, line_no long, value string, missing_file string"
#: Characters of text that are read and sent on together.
PIECE = 1 << 22


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); a path without a scheme is local."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Member(InputPartition):
    path: str
    member: str | None
    missing: str | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.expected = options["path"], options.get("expected")
        self.every = options.get("members", "one") == "all"
        self.encoding = options.get("encoding", "latin1")

    def archives(self) -> list[str]:
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

    def partitions(self) -> list[Member]:
        store, out = store_of(self.path)[0], []
        for path in self.archives():
            with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".txt")]
            missing = self.expected if self.expected and self.expected not in names else None
            picked = names if self.every else [self.expected if self.expected in names else names[0]] if names else []
            out += [Member(path, n, missing) for n in picked] or [Member(path, None, missing)]
        return out or [Member("", None, None)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "line_no", "value", "missing_file"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def batch(lines: list, start: int) -> pa.RecordBatch:
            n = len(lines)
            columns = [[partition.path] * n, [partition.member] * n, range(start, start + n), lines, [partition.missing] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        if partition.member is None:
            if partition.path:
                yield batch([None], 0)
            return
        at = 1
        with store_of(self.path)[0].open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.member) as member:
            text = io.TextIOWrapper(member, encoding=self.encoding)
            while block := text.readlines(PIECE):
                yield batch([line.rstrip("\r\n") for line in block], at)
                at += len(block)


class ArchiveLines(DataSource):
    """Options: ``path`` (archive or folder), ``expected`` member, ``members`` (one, all), ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, expected: str | None = None, every_member: bool = False) -> DataFrame:
    """Lines (path, member, line_no, value, missing_file) of the expected, else the first text member of each archive.

    ``every_member`` reads all text members. ``missing_file`` names an expected member that was absent; an archive
    without text gives one row without value.
    """
    spark.dataSource.register(ArchiveLines)
    reader = spark.read.format("archive_lines").option("members", "all" if every_member else "one")
    return (reader.option("expected", expected) if expected else reader).load(path)
