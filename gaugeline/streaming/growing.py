"""A streaming source that follows growing text files: the lines appended since the last micro-batch, each once.

``spark.readStream.format("growing_lines").load(folder)``, after ``register(spark)``, gives (path, at, raw): the file, the byte
at which the line starts, and the line. The offset of a file is the byte after its last finished line, so a line that is
still being written is held back until it is whole. A micro-batch cuts what is new into splits, which executors read.
Files may appear at any time and only grow; one that is shorter than what was read is taken for a new one and read
again. As a batch source it gives the finished lines there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The source travels by value, so that executors do not need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
SCHEMA = "path string, at long, raw string"
EVENT_FILE = r"([^/]+)\.events\.jsonl$"  # fixed value: the name of a run's event log


class Split(InputPartition):
    """The lines of a file that start at ``start`` or later and before ``end``; no line goes on beyond ``end_of_lines``."""

    def __init__(self, path: str, first: int, start: int, end: int, end_of_lines: int):
        self.path, self.first, self.start, self.end, self.end_of_lines = path, first, start, end, end_of_lines


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its URI, and the path there."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    """The byte after the last line break among the first ``size`` bytes."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(0, end - READ_BYTES)
            found = file.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def split_lines(path: str, start: int, end: int) -> Iterator[Split]:
    for at in range(start, end, SPLIT_BYTES):
        yield Split(path, start, at, min(at + SPLIT_BYTES, end), end)


def lines_of(system: fs.FileSystem, split: Split) -> Iterator[pa.RecordBatch]:
    """The lines of a split; one that starts in the split before it is passed over."""
    with system.open_input_file(split.path) as file:
        at, rest = split.start, b""
        if split.start > split.first:
            at, skipping = split.start - 1, True  # a break just before the split: its first line starts here
            while skipping and at < split.end_of_lines:
                data = file.read_at(min(READ_BYTES, split.end_of_lines - at), at)
                found = data.find(b"\n")
                at, skipping = (at + found + 1, False) if found >= 0 else (at + len(data), True)
        begin = at
        while begin < split.end and at < split.end_of_lines:
            data = file.read_at(min(READ_BYTES, split.end_of_lines - at), at)
            at += len(data)
            *whole, rest = (rest + data).split(b"\n")
            starts, texts = [], []
            for line in whole:
                if begin >= split.end:
                    break
                starts.append(begin)
                texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                begin += len(line) + 1
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split.path] * len(texts)), pa.array(starts, pa.int64()), pa.array(texts)], names=["path", "at", "raw"]
                )


class Folder:
    """The files of the source's folder."""

    def __init__(self, options):
        self.system, self.folder = opened(options["path"])
        self.suffix = options.get("suffix", ".jsonl")

    def ends(self, known: dict[str, tuple[int, int]]) -> dict[str, int]:
        """The end of the finished lines per file; ``known`` remembers (size, end) of files that did not change."""
        selector = fs.FileSelector(self.folder, allow_not_found=True, recursive=True)
        for info in self.system.get_file_info(selector):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            if known.get(info.path, (-1, 0))[0] != info.size:
                known[info.path] = (info.size, last_line_end(self.system, info.path, info.size))
        return {path: end for path, (_, end) in sorted(known.items()) if end}


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.known = options, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return Folder(self.options).ends(self.known)

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for path, until in end.items():
            since = start.get(path, 0)
            out += split_lines(path, since if since <= until else 0, until)
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return lines_of(opened(self.options["path"])[0], partition)


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Split]:
        return [s for path, end in Folder(self.options).ends({}).items() for s in split_lines(path, 0, end)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return lines_of(opened(self.options["path"])[0], partition)


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


def growing_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of the lines of a folder's growing files."""
    register(spark)
    return spark.readStream.format("growing_lines").option("suffix", suffix).load(folder)


def growing_events(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, seq, ts, raw of the event logs of a results folder, for ``monitor.stream_events``.

    The byte at which a line starts stands for its number; its time is that of the micro-batch that met it.
    """
    lines = growing_lines(spark, folder, ".events.jsonl")
    return lines.select(
        F.regexp_extract("path", EVENT_FILE, 1).alias("run_id"), F.col("at").alias("seq"), F.current_timestamp().alias("ts"), "raw"
    )
