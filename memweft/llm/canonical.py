"""Duplicates hidden by formatting: canonical keys and an incremental ledger of their counts.

The ledger is a table (bucket, key, copies, n_rows, first_cid, first_hash) in bucket folders, with the cids it has
counted beside it. A batch is aggregated by canonical key, full-outer-joined with the matching buckets, counts are
added and the earliest representative is kept; only buckets the batch touches are rewritten.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.commits import CommitLog
from ..session import scratch_dir
from . import vectext as V

LEDGER = "key binary, copies long, n_rows long, first_cid string, first_hash string"
MEMBERS = "key binary, cid string, hash string, n long, is_new boolean"
#: Rows of a first batch that one bucket should get, and the most buckets.
BUCKET, MOST_BUCKETS = 100_000, 8192
#: Folders of members that a bucket may have before the next batch that touches it makes one of them.
FOLDERS = 8
#: One field: a one-word name, a colon or an equals sign, and a value.
FIELD = r"(?s)^[\s\x{FEFF}]*[\p{L}\p{N}_\-]+\s*[:=].*[\p{L}\p{N}].*$"


def bare(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case, all else removed."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical_key(text: Column) -> Column:
    """128-bit key under which texts that differ only in layout agree; null for a null text.

    A text made up only of ``name: value`` or ``name = value`` fields, one per line or separated by
    ``;``, is compared as the sorted bag of its fields; any other text by its letters and digits in
    order. A text without letters and digits has the key of the empty text: all of them are one record.
    """
    parts = F.filter(F.split(text, r"[\r\n;]+"), lambda p: p.rlike(r"[^\s\x{FEFF}]"))
    is_fields = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(FIELD))
    fields = F.array_join(F.array_sort(F.transform(parts, bare)), "\u0001")
    return F.when(text.isNotNull(), F.unhex(F.md5(F.when(is_fields, fields).otherwise(bare(text)))))


# the white space of Java's ``\\s``, so that both forms of the rule agree
_FIELD = re.compile(r"[ \t\n\x0b\f\r\ufeff]*[\w\-]+[ \t\n\x0b\f\r]*[:=]")
#: Stands between fields; no text has it, as it is half a surrogate pair.
_BETWEEN = "\ud800"


def canonical_hashes(texts: list[str]) -> np.ndarray:
    """64-bit hashes that agree where ``canonical_key`` agrees: the same rule, for batches of texts in Python."""
    bare_ = V.word_table().copy()
    bare_[ord("_")] = False
    rest = []
    for t in texts:
        t = t.lower()
        if _FIELD.match(t):
            parts = [p for p in re.split(r"[\r\n;]+", t) if p.strip("\ufeff \t\x0b\x0c")]
            if len(parts) > 1 and all((m := _FIELD.match(p)) and any(map(str.isalnum, p[m.end() :])) for p in parts):
                t = _BETWEEN.join(sorted("".join(filter(str.isalnum, p)) for p in parts))
        rest.append(t)
    code, offsets = V.codes(rest)
    keep = bare_[code] | (code == ord(_BETWEEN))
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return V.span_hashes(code[keep], at[:-1], at[1:]) if len(texts) else np.empty(0, V.U)


def keyed(chunks: DataFrame) -> DataFrame:
    """(cid, hash, key) of every row that has a cid and a text; a null hash stays null."""
    return chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", "hash", canonical_key(F.col("text")).alias("key"))


class Ledger:
    """Canonical-key counts and their members in buckets by key, updated batch by batch; durable below ``root``.

    The commit log below ``root`` says which folder holds each bucket and which batches are in; a Ledger opened on it
    by another process goes on from there. An update writes the buckets it touches to a new folder and then
    commits; one that dies before has not happened and can be tried again, and a batch name that is already in is
    passed over. A cid that an earlier batch delivered isn't counted again in ``copies``, only in ``n_rows``.
    "Earliest" is the smallest cid, so the result does not depend on the order of the batches. ``buckets`` is fixed by the
    first batch: by default in proportion to its rows.
    """

    def __init__(self, spark, root: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.log = CommitLog(spark, root or scratch_dir(spark))

    def _read(self, name: str, schema: str, mark: dict | None, which=None) -> DataFrame:
        """The table ``name`` of the buckets in ``which`` (default: all)."""
        parts = mark[name] if mark else {}
        folders = [f"{f}/{name}/bucket={b}" for b, fs in parts.items() if which is None or int(b) in which for f in fs]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self.log.at, folders))

    def table(self) -> DataFrame:
        """The whole ledger: (key, copies, n_rows, first_cid, first_hash)."""
        return self._read("ledger", LEDGER, self.log.last())

    def members(self) -> DataFrame:
        """(key, cid) of every cid counted, once."""
        return self._read("members", MEMBERS, self.log.last()).where("is_new").select("key", "cid")

    def update(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add a batch of (cid, hash, key) rows. A ``batch`` of a name that is in already changes nothing.

        Repeated rows of one cid count once. Every aggregation combines before it shuffles, so a record that holds a
        third of all rows costs its task one row per map task and cid, or one per map task.
        """
        mark = self.log.last() or {"number": 0, "ledger": {}, "members": {}, "batches": [], "buckets": self.buckets}
        if batch is not None and batch in mark["batches"]:
            return
        buckets = mark["buckets"] or min(MOST_BUCKETS, max(16, -(-rows.count() // BUCKET)))
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
        folder = self.log.folder()
        # rebalanced, not repartitioned: the bucket of a hot record is cut into as many files as it needs
        put = lambda df, name: df.hint("rebalance", F.col("bucket")).write.option("compression", "zstd").partitionBy("bucket").parquet(self.log.at(f"{folder}/{name}"))
        per_cid = rows.groupBy("key", "cid").agg(F.max("hash").alias("hash"), F.count(F.lit(1)).alias("n"))
        touched, crowded = None, set()
        if mark["ledger"]:
            # which cids are new: matched with the members of the same keys, which lie in the same buckets
            touched = {r["bucket"] for r in rows.select(bucket).distinct().collect()}  # at most MOST_BUCKETS
            crowded = {b for b in touched if len(mark["members"].get(str(b), [])) >= FOLDERS}
            seen = self._read("members", MEMBERS, mark, touched).where("is_new").select("key", "cid", F.lit(True).alias("old"))
            per_cid = per_cid.join(seen, ["key", "cid"], "left").select("key", "cid", "hash", "n", F.col("old").isNull().alias("is_new"), bucket)
        else:
            per_cid = per_cid.select("*", F.lit(True).alias("is_new"), bucket)
        try:
            put(per_cid, "members")
            new = self.spark.read.schema(MEMBERS).parquet(self.log.at(f"{folder}/members")).groupBy("key")
            new = new.agg(F.count_if("is_new").alias("copies"), F.sum("n").alias("n_rows"), F.min(F.when(F.col("is_new"), F.struct("cid", "hash"))).alias("first"))
            if mark["ledger"]:
                old = self._read("ledger", LEDGER, mark, touched).select("key", "copies", "n_rows", F.struct(F.col("first_cid").alias("cid"), F.col("first_hash").alias("hash")).alias("first"))
                n, o = new.alias("n"), old.alias("o")
                add = lambda c: (F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).alias(c)
                earliest = F.when(F.col("o.first").isNull() | (F.col("n.first.cid") < F.col("o.first.cid")), F.col("n.first")).otherwise(F.col("o.first"))
                new = n.join(o, F.col("n.key") == F.col("o.key"), "full_outer").select(F.coalesce("o.key", "n.key").alias("key"), add("copies"), add("n_rows"), earliest.alias("first"))
            put(new.select("key", "copies", "n_rows", F.col("first.cid").alias("first_cid"), F.col("first.hash").alias("first_hash"), bucket), "ledger")
            if crowded:
                put(self._read("members", MEMBERS, mark, crowded).where("is_new").select("*", bucket), "older/members")
            here = lambda name: {d["bucket"] for d in self._written(f"{folder}/{name}")}
            ledger = {**mark["ledger"], **{str(b): [folder] for b in here("ledger")}}
            members = {b: [f"{folder}/older"] if int(b) in crowded else fs for b, fs in mark["members"].items()}
            for b in here("members"):
                members[str(b)] = [*members.get(str(b), []), folder]
            batches = [*mark["batches"], *([batch] if batch is not None else [])]
            self.log.commit(mark["number"] + 1, {"ledger": ledger, "members": members, "buckets": buckets, "batches": batches})
        except BaseException:
            self.log.discard(folder)
            raise

    def _written(self, relative: str):
        """The different buckets of a table that was just written (at most MOST_BUCKETS)."""
        schema = (LEDGER if relative.endswith("ledger") else MEMBERS) + ", bucket int"
        return self.spark.read.schema(schema).parquet(self.log.at(relative)).select("bucket").distinct().collect()

    def drop(self) -> None:
        self.log.drop()
