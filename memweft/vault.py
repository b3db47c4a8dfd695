"""One tenant's directory of notes and its index."""

from __future__ import annotations

import hashlib
import os
import threading
import time
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RecallConfig, cache_home
from .local import MOST_BYTES, LocalIndex, index_bytes
from .plans import batch, index
from .session import ship
from .sources import cards
from .sources.querylog import Recall, RecallLog
from .store import SnapshotStore


def default_session() -> SparkSession:
    spark = SparkSession.builder.appName("memweft").config("spark.sql.shuffle.partitions", os.environ.get("MEMWEFT_PARTITIONS", "8")).config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def index_name(tenant_dir: str) -> str:
    """Name of a directory's index: its base name and the first 16 hex digits of the hash of its absolute path."""
    where = os.path.abspath(tenant_dir)
    return f"{os.path.basename(where) or 'root'}-{hashlib.sha256(where.encode()).hexdigest()[:16]}"


class Vault:
    """Index and search one directory. The files are the truth; the index lies elsewhere and can be rebuilt."""

    def __init__(self, tenant_dir: str, config: RecallConfig | None = None, spark: SparkSession | None = None, notes: DataFrame | None = None):
        """``notes`` (path, text, mtime) stands for the files of the directory, if it is given."""
        self.notes = notes
        self.dir = os.path.abspath(os.path.expanduser(tenant_dir))
        self.config = config or RecallConfig()
        os.makedirs(self.dir, exist_ok=True)
        self.spark = spark or default_session()
        ship(self.spark)
        base = os.path.expanduser(self.config.db_dir) if self.config.db_dir else cache_home()
        self.tenant = os.path.basename(self.dir) or "root"
        self.index_path = os.path.join(base, index_name(self.dir))
        self.store = SnapshotStore(self.index_path)
        self._healing = threading.Lock()
        self._local: tuple[int, LocalIndex | None] = (0, None)

    def reindex(self, full: bool = False, now: float | None = None) -> dict:
        return index.reindex(self.spark, self.store, self.dir, self.tenant, self.config, full, now, self.notes)

    def snapshot(self) -> index.Snapshot:
        return index.Snapshot(self.spark, self.store, self.store.current())

    def recall(self, queries: DataFrame) -> DataFrame:
        """Batch recall of (qid, query, k) rows over the current snapshot."""
        snap = self.snapshot()
        if index.mismatch(snap.meta, self.config):
            raise ValueError("the index was built with another model; reindex first")
        hits = batch.recall(snap, self.config, queries, time.time())
        return hits.select(F.lit(self.tenant).alias("tenant"), "*")

    def _held(self, meta: dict) -> LocalIndex | None:
        """The current version in memory, if it is small enough; read once."""
        version, held = self._local
        if version != meta["version"]:
            snap = index.Snapshot(self.spark, self.store, meta)
            held = LocalIndex(snap, self.config) if index_bytes(snap) <= MOST_BYTES else None
            self._local = (meta["version"], held)
        elif held is not None:
            held.snapshot.check()
        return held

    def _found(self, meta: dict, queries: Sequence[str | None], k: int) -> Iterator[list[dict]]:
        held = self._held(meta)
        if held is not None:
            for q in queries:
                yield held.search(q, k, self.config, time.time())
            return
        asked = self.spark.createDataFrame([(i, q, k) for i, q in enumerate(queries)], "qid long, query string, k int")
        rows = self.recall(asked).select("qid", "pos", "id", "score", "file", "text").orderBy("qid", "pos").toLocalIterator()
        by, n = groupby(rows, key=lambda r: r["qid"]), self.config.snippet_chars
        at, hits = next(by, (None, ()))
        for i in range(len(queries)):
            if at != i:
                yield []
                continue
            yield [{"id": r["id"], "score": r["score"], "file": r["file"], "text": r["text"], "snippet": r["text"][:n] if n > 0 else r["text"]} for r in hits]
            at, hits = next(by, (None, ()))

    def search_all(self, queries: Sequence[str | None], k: int = 5) -> Iterator[list[dict]]:
        """The hits of each query in order, as ``search`` gives them; a large index is searched by one plan for all.

        The hits come one query after the other, so that they needn't be in memory together.
        """
        meta, done, start = self.store.current(), 0, time.perf_counter()
        if index.mismatch(meta, self.config):
            raise ValueError("the index was built with another model; reindex first")
        log = RecallLog.configured()

        def logged(hits: list[dict]) -> list[dict]:
            took = (time.perf_counter() - start) * 1000
            log.append(Recall(os.path.basename(self.dir), queries[done], tuple((h["score"], h["file"]) for h in hits), time.time(), took))
            return hits

        try:
            for hits in self._found(meta, queries, k) if meta is not None else ():
                logged(hits)
                done += 1
                yield hits
                if self._local[1] is not None:  # each question by itself
                    start = time.perf_counter()
        except Exception as e:
            if not _damaged(e):
                raise
            self.heal()
        while done < len(queries):
            logged([])
            done += 1
            yield []

    def search(self, query: str, k: int = 5) -> list[dict]:
        """The hits of one query in order; every search is logged.

        A missing index gives no hits. So does one that can't be read, which is then rebuilt in the
        background, one rebuild at a time.
        """
        return next(self.search_all([query], k))

    def record(self, content: str, title: str | None = None) -> str:
        """Keep a fact as a note of its own and index it; returns the note's file name."""
        fact = self.spark.range(1).select(F.lit(title).cast("string").alias("title"), F.lit(content).alias("content"), F.current_timestamp().alias("at"))
        (row,) = cards.write_cards(fact, self.dir).collect()
        self.reindex()
        return row["file"]

    def heal(self) -> threading.Thread | None:
        """Rebuild in the background unless a rebuild is under way."""
        if not self._healing.acquire(blocking=False):
            return None

        def run():
            try:
                self.reindex()  # under the store's lock it sees the damage, reads all files again and keeps what vectors are whole
            except Exception:
                pass
            finally:
                self._healing.release()

        t = threading.Thread(target=run, daemon=True)
        t.start()
        return t

    def stats(self) -> dict:
        row = index.index_counts(self.snapshot().chunks).first() or {"files": 0, "chunks": 0}
        return {"files": row["files"], "chunks": row["chunks"], "index": self.index_path}


def _damaged(e: Exception) -> bool:
    """Whether an error comes from index files that are missing or unreadable."""
    text = str(e)
    return isinstance(e, index.DamagedIndex) or any(s in text for s in ("PATH_NOT_FOUND", "FileNotFound", "does not exist", "FAILED_READ_FILE", "CANNOT_READ_FILE", "not a Parquet file", "UNABLE_TO_INFER_SCHEMA"))
