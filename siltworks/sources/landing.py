"""Landing folders: files listed in tasks, and the first bytes of each.

The listing is a Spark data source written in Python. The driver looks at the folder's own entries only; each folder below it is
listed by a task, and each file is opened by a task that reads no more than its head. Spark's own readers load a file whole to give
its first bytes, and leave out files without a byte.

Stores are reached through Arrow's file systems (local, s3, gs, abfs, hdfs). A folder in a store that only Spark's readers reach is
read by these: then files are loaded whole, and files without a byte are missing.

Names that begin with "." or "_" are passed over, with all below them, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of the folder itself that one task takes.
FILES_A_TASK = 1000


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """Arrow's file system for a path, the path in it, and what stands before it in a full name."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    store, inner = fs.FileSystem.from_uri(path)
    at = path.find(inner)
    return store, inner, path[:at] if at > 0 else path.split("://")[0] + "://"


def _shown(path: str, root: str) -> bool:
    return not any(part.startswith((".", "_")) for part in path.removeprefix(root).split("/") if part)


class _Part(InputPartition):
    """Folders to list, or files as they are."""

    def __init__(self, folders: list[str], files: list[tuple[str, int]]):
        self.folders, self.files = folders, files


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        store, root, before = store_of(self.path)
        entries = store.get_file_info(fs.FileSelector(root, recursive=False))
        shown = [e for e in entries if _shown(e.path, root)]
        files = [(before + e.path, e.size) for e in shown if e.type == fs.FileType.File]
        parts = [_Part([e.path], []) for e in shown if e.type == fs.FileType.Directory]
        return parts + [_Part([], files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)] or [_Part([], [])]

    def read(self, partition: _Part) -> Iterator[tuple[str, int]]:
        yield from partition.files
        store, root, before = store_of(self.path)
        waiting = list(partition.folders)
        while waiting:
            for e in store.get_file_info(fs.FileSelector(waiting.pop(), recursive=False)):
                if not _shown(e.path, root):
                    continue
                if e.type == fs.FileType.Directory:
                    waiting.append(e.path)
                elif e.type == fs.FileType.File:
                    yield before + e.path, e.size


class LandingFiles(DataSource):
    """spark.read.format("landing_files").load(path): (path, length) of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "landing_files"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def reached(path: str) -> bool:
    """Whether Arrow has a file system for a path."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder."""
    spark.dataSource.register(LandingFiles)
    return spark.read.format("landing_files").load(path)


def heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, length, head) of all files below a folder: at most the first `size` bytes of each. Files are dealt evenly to tasks,
    whatever folders they lie in."""
    if not reached(path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.select("path", "length", F.substring("content", 1, size).alias("head"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for batch in batches:
            # a batch of heads is at most 64 files
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = []
                for name in part.column(0).to_pylist():
                    store = store or store_of(name)[0]
                    with store.open_input_file(store_of(name)[1]) as f:
                        found.append(f.read(size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=["path", "length", "head"])

    dealt = listing(spark, path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, "path string, length long, head binary")
