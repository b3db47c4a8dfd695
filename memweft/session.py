"""Session helpers: reading tables, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple] = []
_bases: list[tuple] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new directory all executors can reach.

    It lies under ``spark.checkpoint.dir``, the folder the cluster shares. Only in local mode, where that may be
    unset, is a machine-local folder made, once per session; on a cluster the setting must be there, as
    executors that each write to a disk of their own would lose rows silently.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = getattr(spark.sparkContext, "_memweft_scratch", None)
        if local is None:
            local = "file://" + tempfile.mkdtemp(prefix="memweft-")
            spark.sparkContext._memweft_scratch = local
            _bases.append((spark.sparkContext, local))
        base = local
    return f"{base.rstrip('/')}/memweft-{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch space and read it back: a lineage cut that survives lost executors.

    The schema is kept as it was, except that Parquet makes every column nullable.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    _made.append((spark.sparkContext, path))
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(sc, path: str) -> None:
    jvm = sc._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(since: int = 0) -> None:
    """Delete the scratch tables made after the first ``since``; plans that read them are done then."""
    _delete(_made[since:])
    del _made[since:]


def _delete(made) -> None:
    for sc, path in made:
        try:
            if sc._jsc is not None:
                delete_path(sc, path)
        except Exception:  # the JVM may be gone already
            return


@contextmanager
def scratch():
    """Delete, at the end of the block, the scratch tables made in it. Results must have been written or collected by then."""
    since = len(_made)
    try:
        yield
    finally:
        release(since)


atexit.register(lambda: _delete(_made + _bases))


def ship(spark: SparkSession) -> None:
    """Make the package importable by the Python workers of every executor; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_memweft_shipped", False):
        return
    import os
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="memweft-ship-"), "memweft.zip")
    with zipfile.ZipFile(to, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("memweft", os.path.relpath(full, root)))
    sc.addPyFile(to)
    sc._memweft_shipped = True
