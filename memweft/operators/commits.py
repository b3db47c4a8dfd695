"""A folder of versions with an atomic commit log, on any file system that Hadoop reaches.

A writer makes a new folder below ``data/`` under a name nobody else uses, writes tables into it, and then
publishes by renaming a small finished file to ``commits/<number>``, which fails if that number exists. So a
version is either there whole, together with whatever its entry says (a watermark, a batch's name), or not at
all; of two writers that race for a number one wins, and what the other wrote is never read. The rename is
atomic where the file system's is (HDFS, POSIX mounts); on object stores a committer with the same promise is needed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this number."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        for sub in ("commits", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{sub}"))

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{number}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The latest entry, or None."""
        have = self.numbers()
        return self.read(have[-1]) if have else None

    def folder(self) -> str:
        """A new name below ``data/``, relative to the root."""
        return f"data/{uuid.uuid4().hex}"

    def at(self, relative: str) -> str:
        return f"{self.root}/{relative}"

    def commit(self, number: int, entry: dict) -> dict:
        """Publish ``entry`` as ``number``; raises Conflict if that exists."""
        entry = {**entry, "number": number}
        aside, final = self._path(f"{self.root}/commits/.{number}-{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{number}")
        out = self._fs.create(aside, False)
        out.write(json.dumps(entry).encode())
        out.hsync()
        out.close()
        jvm = self.spark.sparkContext._jvm
        try:
            # unlike FileSystem.rename, this one refuses an existing target
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).getFileSystem(self._conf).getUri(), self._conf).rename(aside, final, self._renames())
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"number {number} is committed already") from e
            raise
        return entry

    def _renames(self):
        """An empty array of rename options: an existing target is an error."""
        sc = self.spark.sparkContext
        return sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def discard(self, relative: str) -> None:
        self._fs.delete(self._path(self.at(relative)), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)
