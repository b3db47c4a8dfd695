"""Markdown directories as a Spark data source, ``spark.read.format("markdown_vault")``.

Spark's own file listing drops names that start with ``_`` or ``.`` and cuts modification times to
milliseconds; notes have such names and are compared by exact time. So the source walks the
directory itself and reads files in batches on the executors.

Options: ``recursive`` (default false), ``content`` (default true; false lists without reading), ``tenant``
(default: the directory's name), ``batch`` (files a partition, default 256).
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tenant string, path string, mtime double, n_bytes long, text string"


def walk(root: str, recursive: bool):
    """(key, full path) of the notes of a directory.

    Flat: ``*.md`` of the directory but dot files, by name. Recursive: all ``.md`` files below, dot files
    included but not dot directories, by path relative to the directory.
    """
    if not recursive:
        for e in os.scandir(root):
            if e.name.endswith(".md") and not e.name.startswith(".") and e.is_file():
                yield e.name, e.path
        return
    todo = [root]
    while todo:
        at = todo.pop()
        for e in os.scandir(at):
            if e.is_dir(follow_symlinks=False):
                if not e.name.startswith("."):
                    todo.append(e.path)
            elif e.name.endswith(".md") and e.is_file():
                yield os.path.relpath(e.path, root).replace(os.sep, "/"), e.path


def read_text(path: str) -> str | None:
    """UTF-8 with invalid bytes dropped and newlines made ``\\n``; null if the file is gone."""
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read()
    except OSError:
        return None


class _Files(InputPartition):
    def __init__(self, files):
        super().__init__(files)


class MarkdownReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        true = lambda k, d: options.get(k, d).lower() == "true"
        self.recursive, self.content = true("recursive", "false"), true("content", "true")
        self.tenant = options.get("tenant") or os.path.basename(self.root)
        self.batch = int(options.get("batch", "256"))

    def partitions(self):
        files = sorted(walk(self.root, self.recursive))
        return [_Files(files[i : i + self.batch]) for i in range(0, len(files), self.batch)] or [_Files([])]

    def read(self, partition):
        for key, full in partition.value:
            try:
                st = os.stat(full)
            except OSError:
                continue
            yield self.tenant, key, st.st_mtime, st.st_size, read_text(full) if self.content else None


class MarkdownVault(DataSource):
    @classmethod
    def name(cls):
        return "markdown_vault"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MarkdownReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownVault)


def read_vault(spark: SparkSession, root: str, recursive: bool = False, content: bool = True, tenant: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("markdown_vault").option("recursive", str(recursive)).option("content", str(content))
    return (reader.option("tenant", tenant) if tenant else reader).load(root)


def table_notes(notes: DataFrame, recursive: bool) -> DataFrame:
    """(path, mtime, text) of notes (path, text, mtime) as they are read once written as files: names that ``walk`` takes, newlines made ``\\n``."""
    path = F.col("path")
    named = ~path.rlike(r"(^|/)\.[^/]*/") if recursive else ~path.contains("/") & ~path.startswith(".")
    return notes.where("text IS NOT NULL").where(path.endswith(".md") & named).select("path", "mtime", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


def with_text(files: DataFrame, root: str) -> DataFrame:
    """Read the files of (tenant, path, mtime) rows below ``root`` on the executors; only these are opened."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[read_text(os.path.join(root, p)) for p in pdf["path"]]) if len(pdf) else pd.DataFrame({"tenant": [], "path": [], "mtime": [], "text": []})

    return files.select("tenant", "path", "mtime").mapInPandas(run, "tenant string, path string, mtime double, text string")


def write_notes(notes: DataFrame, root: str) -> int:
    """Write notes (path, text, mtime) as files below ``root``, a folder that executors share; returns how many.

    Folders are made as needed, newlines are kept as they are, and a note replaces one of its path. Notes without a
    path or text are left out; a null mtime leaves the time of writing.
    """

    def run(batches):
        for pdf in batches:
            for path, text, mtime in zip(pdf["path"], pdf["text"], pdf["mtime"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", errors="ignore", newline="") as f:
                    f.write(text)
                if mtime == mtime and mtime is not None:
                    os.utime(full, (mtime, mtime))
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = notes.where("path IS NOT NULL AND text IS NOT NULL").select("path", "text", "mtime")
    return sum(r["n"] for r in rows.mapInPandas(run, "n long").collect())  # a number a batch
