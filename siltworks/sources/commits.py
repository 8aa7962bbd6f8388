"""A log of commits beside tables: what a load has written counts once its commit is there, and not before.

A commit is one small JSON file, put in place by a rename. It names the load's batch and what it wrote. Readers take the log's
entries and read what these name, so of a load that broke off nothing is ever read, and a batch whose commit is there is known when
it comes again. A log has one writer at a time, as a stream or a scheduled job has.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitLog:
    """Commits of one folder, numbered from 0."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = f"{root.rstrip('/')}/_commits"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._utils = spark._jvm.org.apache.commons.io.IOUtils

    def _names(self) -> list[str]:
        if not self._files.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _read(self, name: str) -> dict:
        stream = self._files.open(self._hadoop.Path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(self._utils.toByteArray(stream)))
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """All commits, oldest first."""
        return [self._read(n) for n in self._names()]

    def last(self) -> dict | None:
        names = self._names()
        return self._read(names[-1]) if names else None

    def find(self, batch: str) -> dict | None:
        """The commit of a batch, if there is one."""
        return next((e for e in self.entries() if e.get("batch") == batch), None)

    def commit(self, entry: dict) -> None:
        """Puts an entry behind the others. The file is written under a hidden name first and then renamed, so it is there whole or not."""
        names = self._names()
        number = int(names[-1].removesuffix(".json")) + 1 if names else 0
        hidden, final = (self._hadoop.Path(f"{self.path}/{n}") for n in (f".{number:09d}.tmp", f"{number:09d}.json"))
        out = self._files.create(hidden, True)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(hidden, final):
            raise RuntimeError(f"another writer has made commit {number} of {self.path}")
