"""Index build: snapshot diff, chunking, embedding of what is new, and the next version of what changed.

The tables of a snapshot lie in buckets by hash of the file's path, the cache of vectors in the folders of the runs that
made them. A run rewrites the buckets whose files changed, adds a folder of new vectors, and refers to the
folders of earlier versions for all else.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..functions.text import ignored
from ..operators import chunking, keyword, vectors
from ..session import materialize
from ..sources.markdown import read_vault, table_notes, with_text
from ..store import SnapshotStore

CHUNKS = "tenant string, cid string, path string, hash string, seq int, text string, age_days double, evergreen boolean, mtime double, dl int, fresh boolean"
CACHE = "hash string, model string, vec array<float>"
MANIFEST = "tenant string, path string, mtime double"
#: Occurrences are kept as the terms of each chunk in order; a row for each would repeat the cid, most of its bytes.
OCC = "tenant string, cid string, terms array<string>"
SCHEMAS = {"chunks": CHUNKS, "emb_cache": CACHE, "manifest": MANIFEST, "occurrences": OCC}
#: Tables in buckets; files that one bucket should have when an index is begun; folders of vectors before they are made one.
BUCKETED, FILES, FOLDERS = ("chunks", "manifest", "occurrences"), 5000, 16
#: Files that a task reads and cuts.
TASK = 2000


def listing(spark: SparkSession, root: str, tenant: str, config: RecallConfig, notes: DataFrame | None = None) -> DataFrame:
    """(tenant, path, mtime) of the notes on disk, or of a table, that no ignore glob drops."""
    files = read_vault(spark, root, config.recursive, content=False, tenant=tenant) if notes is None else table_notes(notes, config.recursive).withColumn("tenant", F.lit(tenant))
    files = files.select("tenant", "path", "mtime")
    return files.where(~ignored(F.col("path"), config.ignore_globs)) if config.ignore_globs else files


def missing_vectors(texts: DataFrame, cache: DataFrame, models: DataFrame) -> DataFrame:
    """(hash, model) of the texts (hash, ...) that have no vector by a model of ``models`` (model), each once.

    ``cache`` is (hash, model, vec); a null vector counts as none, a null hash as no text.
    """
    want = texts.where("hash IS NOT NULL").select("hash").distinct().join(F.broadcast(models.select("model").distinct()), how="cross")  # a row a model
    return want.join(cache.where("vec IS NOT NULL").select("hash", "model"), ["hash", "model"], "left_anti")


def index_counts(chunks: DataFrame) -> DataFrame:
    """(tenant, chunks, files): how many different chunks and files each tenant has."""
    return chunks.groupBy("tenant").agg(F.countDistinct("cid").alias("chunks"), F.countDistinct("path").alias("files"))


def chunk_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(tenant, cid, vec): the cached vector of each chunk by ``model``; chunks without one are left out."""
    return chunks.select("tenant", "cid", "hash").join(cache.where(F.col("model") == model).select("hash", "vec"), "hash").select("tenant", "cid", "vec")


class DamagedIndex(Exception):
    """Files of a published snapshot are missing."""


def part_files(folder: str) -> list[str]:
    try:
        return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("part-"))
    except OSError:
        return []


class Snapshot:
    """The tables of one published version. Raises DamagedIndex if files of it are missing."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, meta: dict | None):
        self.spark, self.store, self.meta = spark, store, meta
        self.check()

    def check(self) -> None:
        for name in SCHEMAS if self.meta else ():
            for folder, n in self.folders(name):
                if len(part_files(folder)) != n:
                    raise DamagedIndex(f"version {self.meta['version']} lacks files of {name}")

    def folders(self, name: str, buckets=None) -> list[tuple[str, int]]:
        """(folder, part files) of a table, or of some of its buckets."""
        places = self.meta["tables"][name] if self.meta else {}
        return [(os.path.join(self.store.root, f), n) for key, (f, n) in places.items() if buckets is None or int(key) in buckets]

    def files(self, name: str) -> list[str]:
        return [p for folder, _ in self.folders(name) for p in part_files(folder)]

    def table(self, name: str, buckets=None) -> DataFrame:
        paths = [f for f, n in self.folders(name, buckets) if n]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    chunks = property(lambda self: self.table("chunks"))
    cache = property(lambda self: self.table("emb_cache"))
    manifest = property(lambda self: self.table("manifest"))
    occ = property(lambda self: self.table("occurrences").select("tenant", "cid", F.posexplode("terms").alias("pos", "term")))
    lengths = property(lambda self: self.chunks.select("tenant", "cid", "dl"))


def mismatch(meta: dict | None, config: RecallConfig) -> bool:
    """Whether the index was made with another model or dimension, whose vectors can't be compared."""
    return bool(meta) and (meta.get("model") != config.model or meta.get("dim") != config.dim)


def _kept_cache(spark: SparkSession, store: SnapshotStore, meta: dict) -> dict:
    """The folders of vectors of a damaged version that are still whole."""
    return {k: (f, n) for k, (f, n) in meta.get("tables", {}).get("emb_cache", {}).items() if len(part_files(os.path.join(store.root, f))) == n}


def reindex(spark: SparkSession, store: SnapshotStore, root: str, tenant: str, config: RecallConfig, full: bool = False, now: float | None = None, notes: DataFrame | None = None) -> dict:
    """Bring the index up to date with the directory; all or nothing. Returns the run's counters.

    Only files whose mtime differs from the last snapshot's are opened, and only their buckets are rewritten. Texts are
    embedded once for each content hash that the cache lacks. ``full`` reads everything again but keeps cached
    vectors, as does a run over an index whose files are damaged; a change of model or dimension starts from nothing.
    The old version stays current until the new one is complete. ``notes`` (path, text, mtime) is a table that stands for
    the directory; it has each path once.
    """
    now = time.time() if now is None else now
    with store.lock():
        meta = store.current()
        fresh = mismatch(meta, config)
        old = None
        cache = {} if fresh or not meta else meta["tables"]["emb_cache"]
        if meta and not fresh:
            try:
                old = Snapshot(spark, store, meta)
            except DamagedIndex:
                full, cache = True, _kept_cache(spark, store, meta)
        keep = old if old and not full else Snapshot(spark, store, None)
        disk = materialize(listing(spark, root, tenant, config, notes))
        buckets = meta["buckets"] if keep.meta else max(1, -(-disk.count() // FILES))
        bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
        was = keep.manifest.select("path", F.col("mtime").alias("was"))
        state = F.when(F.col("mtime").isNull(), "gone").when(F.col("mtime").eqNullSafe(F.col("was")), "same").otherwise("due")
        files = materialize(disk.select("path", "mtime").join(was, "path", "full_outer").select("path", "mtime", state.alias("state"), bucket))
        counts = {(r["state"], r["bucket"]): r["n"] for r in files.groupBy("state", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows a bucket
        count = lambda *states: sum(n for (s, _), n in counts.items() if s in states)
        touched = sorted({b for s, b in counts if s != "same"})
        result = {"files_total": count("same", "due"), "files_reindexed": count("due"), "chunks": 0, "embedded": 0, "cached": 0}
        if keep.meta and not touched:
            return result
        version = store.next_version()
        try:
            # files are dealt to tasks before they are read, so that a bucket has few part files and no text is shuffled
            due, tasks = files.where("state = 'due'").select("path", "mtime", "bucket"), max(1, -(-result["files_reindexed"] // TASK))
            if notes is None:
                texts = with_text(due.repartitionByRange(tasks, "bucket", "path").select(F.lit(tenant).alias("tenant"), "path", "mtime"), root)
            else:
                texts = table_notes(notes, config.recursive)
                texts = texts.where(~ignored(F.col("path"), config.ignore_globs)) if not keep.meta else texts.drop("mtime").join(due, "path")
                texts = texts.withColumn("bucket", bucket).repartitionByRange(tasks, "bucket", "path").select(F.lit(tenant).alias("tenant"), "path", "mtime", "text")
            made = chunking.chunk_files(texts, config, now)
            made = made.withColumn("dl", F.greatest(F.size(keyword.keyword_tokens("text")), F.lit(0))).withColumn("fresh", F.lit(True))
            columns = [c.split()[0] for c in CHUNKS.split(", ")]
            rows = made.select(*columns, bucket)
            if keep.meta:
                same = files.where("state = 'same'").select("path")
                rows = keep.table("chunks", touched).withColumn("fresh", F.lit(False)).join(same, "path", "left_semi").select(*columns, bucket).unionByName(rows).repartition("bucket")
            written = {}

            def write(df: DataFrame, name: str, by=("bucket",)) -> DataFrame:
                """Write a table of the version in buckets, or one without any as it is, and read it."""
                at = store.path(version, name)
                out = df.write.option("compression", "zstd")
                (out.partitionBy(*by) if by else out).parquet(at)
                rel = os.path.relpath(at, store.root)
                places = [d for d in os.listdir(at) if d.startswith("bucket=")] if by else [""]
                written[name] = {(p[7:] or str(version)): (os.path.join(rel, p).rstrip("/"), len(part_files(os.path.join(at, p)))) for p in places}
                return spark.read.schema(SCHEMAS[name] + (", bucket int" if by else "")).parquet(at)

            chunks = write(rows, "chunks")
            new = chunks.where("fresh")
            store_cache = Snapshot(spark, store, {"version": version, "tables": {**dict.fromkeys(BUCKETED, {}), "emb_cache": cache}}).cache
            lacking = missing_vectors(new, store_cache, spark.createDataFrame([(config.model,)], "model string"))
            texts = new.select("hash", "text").dropDuplicates(["hash"]).join(lacking, "hash")
            made_vecs = texts.select("hash", "model", vectors.embed(F.col("text"), config.model, config.dim).alias("vec"))
            n_made = lacking.count()
            if len(cache) >= FOLDERS:  # one folder again
                made_vecs, cache = store_cache.unionByName(made_vecs), {}
            write(made_vecs, "emb_cache", by=())
            write(files.where("state <> 'gone'").where(F.col("bucket").isin(touched or [-1])).select(F.lit(tenant).alias("tenant"), "path", "mtime", "bucket").repartition("bucket"), "manifest")
            # from the chunks' files, each of one bucket, so nothing is shuffled
            write(chunks.select("tenant", "cid", F.coalesce(keyword.keyword_tokens("text"), F.array().cast("array<string>")).alias("terms"), "bucket"), "occurrences")
            result["chunks"], result["embedded"] = new.count(), n_made
            result["cached"] = result["chunks"] - result["embedded"]
            earlier = keep.meta["tables"] if keep.meta else {}
            tables = {name: {**{b: f for b, f in earlier.get(name, {}).items() if int(b) not in touched}, **written[name]} for name in BUCKETED}
            tables["emb_cache"] = {**cache, **written["emb_cache"]}
            store.publish(version, {"model": config.model, "dim": config.dim, "buckets": buckets, "tables": tables})
        except BaseException:
            store.discard(version)
            raise
        return result
