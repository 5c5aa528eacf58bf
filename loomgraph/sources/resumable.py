"""A data source over sorted files of lines that goes on from any row: "lines_from".

Batch: `spark.read.format("lines_from").option("skip", n).load(folder)` gives the rows from the n-th on. Stream: each
micro-batch takes the next `rows` rows, and Spark's checkpoint keeps the offset, so a stopped stream goes on without gap
or repeat. Rows are counted over the files in the order of their paths; every row has its number.

Options: path (a folder or file that every executor can read by pyarrow's file systems), skip (0), rows (10,000 a
micro-batch), split (50,000: rows of a task). Files that are added later must sort behind the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "row long, line string"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    fs, at = _file_system(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))


def _line_count(path: str, file: str) -> int:
    """Lines of a file, read in blocks; a last line without an end counts."""
    fs, _ = _file_system(path)
    n, last = 0, b"\n"
    with fs.open_input_stream(file) as stream:
        while block := stream.read(1 << 20):
            n, last = n + block.count(b"\n"), block[-1:]
    return n + (last != b"\n")


@dataclass
class Lines(InputPartition):
    """Rows [first, stop) of a file whose first row has the number `base`."""

    file: str
    base: int
    first: int
    stop: int


def _lines(path: str, part: Lines) -> Iterator[tuple[int, str]]:
    fs, _ = _file_system(path)
    at, rest = part.base, b""
    with fs.open_input_stream(part.file) as stream:
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if part.first <= at < part.stop:
                    yield at, line.decode("utf-8", "replace")
                at += 1
                if at >= part.stop:
                    return
    if rest and part.first <= at < part.stop:
        yield at, rest.decode("utf-8", "replace")


class _Counted:
    """Files with the number of their first row; a file is counted once."""

    def __init__(self, options: dict):
        self.path, self.skip = options["path"], int(options.get("skip", 0))
        self.rows, self.split = int(options.get("rows", 10_000)), int(options.get("split", 50_000))
        self.counts: dict[str, int] = {}

    def parts(self, first: int, stop: int | None) -> tuple[list[Lines], int]:
        """The parts of rows [first, stop), and where the rows that are there end."""
        base, parts = 0, []
        for file in _files(self.path):
            if file not in self.counts:
                self.counts[file] = _line_count(self.path, file)
            end = base + self.counts[file]
            low, high = max(first, base), end if stop is None else min(stop, end)
            parts += [Lines(file, base, at, min(at + self.split, high)) for at in range(low, high, self.split)]
            base = end
        return parts, base


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = _Counted(options)

    def partitions(self) -> list[Lines]:
        return self.source.parts(self.source.skip, None)[0] or [Lines("", 0, 0, 0)]

    def read(self, partition: Lines) -> Iterator[tuple[int, str]]:
        return _lines(self.source.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.source, self.given = _Counted(options), None

    def initialOffset(self) -> dict:
        return {"row": self.source.skip}

    def latestOffset(self) -> dict:
        """As far as one micro-batch goes from the last one that was planned."""
        there = self.source.parts(0, 0)[1]
        start = self.source.skip if self.given is None else self.given
        self.given = max(start, min(start + self.source.rows, there))
        return {"row": self.given}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.given = max(self.given or 0, end["row"])
        return self.source.parts(start["row"], end["row"])[0] or [Lines("", 0, 0, 0)]

    def read(self, partition: Lines) -> Iterator[tuple[int, str]]:
        return _lines(self.source.path, partition) if partition.file else iter(())


class LinesFrom(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines_from"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session; the package must be importable by the executors."""
    spark.dataSource.register(LinesFrom)
