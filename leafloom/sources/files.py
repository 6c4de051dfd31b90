"""Files of HTML as a Spark data source, `format("html_files")`, for batches and streams.

A partition is a run of files of about the same size in all. Tasks read files in pieces of CHUNK bytes and stop as soon as a file passes
the limit: such a file gives a row with its length so far and no content, and is never held whole. Rows: page_id (the file's path), url, length,
content, error. Options: path (a folder or a file; its files are those with one of `extensions`, by default .html, .htm and .xhtml), limit
(bytes of a file, by default 4 * max_input) and filesPerPartition.

Paths are of a file system that driver and executors both reach; other stores go by Spark's binary files (`sources.pages.read`).

`write_files` makes such files, one of each row, by Arrow's file systems: each task fills a folder and moves it into place itself, whereas Spark's
writer makes a folder for each value of a column.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from leafloom.errors import InputError
from leafloom.limits import Limits

SCHEMA = "page_id string, url string, length long, content binary, error string"
CHUNK = 64 << 10


def capped(path: str, limit: int) -> tuple[int, bytes | None]:
    """The file's bytes, or how many were read when it passed the limit and None."""
    parts, size = [], 0
    with open(path, "rb") as f:
        while piece := f.read(CHUNK):
            size += len(piece)
            if size > limit:
                return size, None
            parts.append(piece)
    return size, b"".join(parts)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def rows(paths: tuple[str, ...], limit: int) -> Iterator[tuple]:
    for p in paths:
        try:
            size, content = capped(p, limit)
        except OSError as e:  # gone or closed to us between the listing and the read
            yield p, f"file://{p}", None, None, f"cannot be read: {e.strerror}"
            continue
        yield p, f"file://{p}", size, content, None if content is not None else f"over {limit} bytes"


class Options:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise InputError("a path is needed", "path")
        self.extensions = tuple(e.strip().lower() for e in options.get("extensions", ".html,.htm,.xhtml").split(","))
        self.limit = self._whole(options, "limit", 4 * Limits().max_input)
        self.per_partition = self._whole(options, "filesPerPartition", 256)

    @staticmethod
    def _whole(options: dict[str, str], name: str, default: int) -> int:
        value = next((v for k, v in options.items() if k.lower() == name.lower()), None)
        if value is None:
            return default
        if not value.isdigit() or int(value) < 1:
            raise InputError(f"{name} must be a whole number from 1 on", name)
        return int(value)

    def found(self) -> list[tuple[str, int]]:
        """Paths and sizes, in order of paths. Names alone are listed; nothing is opened."""
        if os.path.isfile(self.path):
            return [(os.path.abspath(self.path), os.path.getsize(self.path))]
        if not os.path.isdir(self.path):
            raise InputError("path names no file or folder", "path")
        out = [os.path.join(folder, f) for folder, _, names in os.walk(self.path) for f in names if f.lower().endswith(self.extensions) and not f.startswith((".", "_"))]
        return sorted((os.path.abspath(p), os.path.getsize(p)) for p in out)


def dealt(files: list[tuple[str, int]], per_partition: int) -> list[Files]:
    """Files from the largest on, each to the partition with the fewest bytes so far."""
    loads: list[list] = [[0, i, []] for i in range(max(1, -(-len(files) // per_partition)))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        least = min(loads)
        least[0] += size + CHUNK
        least[2].append(path)
    return [Files(tuple(held)) for _, _, held in loads]


class BatchReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return dealt(self.options.found(), self.options.per_partition)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition.paths, self.options.limit)


class StreamReader(DataSourceStreamReader):
    """New files in order of their paths: an offset is the last path there was. Files are written once and named in rising order."""

    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        found = self.options.found()
        return {"last": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt([f for f in self.options.found() if start["last"] < f[0] <= end["last"]], self.options.per_partition)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition.paths, self.options.limit)


class HtmlFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "html_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(Options(self.options))


def register_source(spark: SparkSession) -> None:
    """Makes `spark.read.format("html_files")` and `spark.readStream.format("html_files")` known."""
    spark.dataSource.register(HtmlFiles)


def store_files(batches: Iterable[pa.RecordBatch], path: str, task: int, attempt: int) -> None:
    """Rows (name, content) of one task as a folder below `path`, named as Spark names partitions. It has a hidden name until it is complete, so that a task which runs
    again, whatever order its rows come in, leaves each row once."""
    store, root = fs.FileSystem.from_uri(path)
    done, part = f"{root}/task={task}", f"{root}/.{attempt}.part"
    if store.get_file_info(done).type != fs.FileType.NotFound:
        return
    store.create_dir(part, recursive=True)
    i = 0
    for b in batches:
        for name, content in zip(b.column(0), b.column(1), strict=True):
            with store.open_output_stream(f"{part}/{i}-{name.as_py()}.html", compression=None) as f:
                f.write(content.as_py())
            i += 1
    store.move(part, done)


def write_files(df: DataFrame, path: str, name: Column, content: Column) -> None:
    """A file of each row of `df` below `path`, a new folder that all machines see: the row's number in its task, `-`, `name` and `.html`. So
    rows of equal names are files of their own, and no name hides its file. Null names and contents are empty."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store_files(batches, path, task.partitionId(), task.taskAttemptId())
        yield from ()

    rows = df.select(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(content, F.lit("")).cast("binary").alias("content"))
    rows.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
