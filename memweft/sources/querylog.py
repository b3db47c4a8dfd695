"""The recall log: its schema, events of a batch of recalls, a typed line writer, and a reader in log order."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LOG_ENV, cache_home

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("event", T.StringType()),
        T.StructField("tenant", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("n_results", T.IntegerType()),
        T.StructField("top_score", T.DoubleType()),
        T.StructField("top_file", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("empty", T.BooleanType()),
    ]
)
#: Scores of a recall that its line keeps.
HEAD = 5


def recall_events(queries: DataFrame, hits: DataFrame, ts: Column, latency_ms: Column) -> DataFrame:
    """(qid, and the log's columns): one event for each of ``queries`` (tenant, qid, query) with its ``hits``.

    ``hits`` is (tenant, qid, pos, score, file); ``pos`` is their order. A query without hits is an event too: no top
    score, no scores, ``empty``. ``ts`` and ``latency_ms`` are expressions over the queries' columns.
    """
    found = hits.groupBy("tenant", "qid").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "file"))).alias("h"))
    rows = queries.select("tenant", "qid", "query", ts.alias("ts"), latency_ms.alias("latency_ms")).join(found, ["tenant", "qid"], "left")
    n, best = F.coalesce(F.size("h"), F.lit(0)), F.get("h", F.lit(0))
    made = {
        "ts": F.round("ts", 3), "event": F.lit("recall"), "n_results": n, "top_score": best["score"], "top_file": best["file"],
        "scores": F.coalesce(F.slice(F.transform("h", lambda x: x["score"]), 1, HEAD), F.array().cast("array<double>")), "latency_ms": F.round("latency_ms", 1), "empty": n == 0,
    }
    return rows.select("qid", *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def as_line() -> Column:
    """A row of the log's columns as a line of JSON. A number that JSON can't say (NaN, infinite) is null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    cols = [finite(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in SCHEMA.fields]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_lines(events: DataFrame, path: str) -> None:
    """Append a batch of events to the log folder ``path``, as files of lines."""
    events.select(as_line().alias("value")).write.mode("append").text(path)


@dataclass(frozen=True)
class Recall:
    """One recall as it is logged; the fields of the log are read from it by name."""

    tenant: str
    query: str
    found: tuple[tuple[float, str], ...]  # (score, file), best first
    ts: float
    latency_ms: float
    event: str = "recall"

    n_results = property(lambda self: len(self.found))
    empty = property(lambda self: not self.found)
    scores = property(lambda self: [s for s, _ in self.found[:HEAD]])
    top_score = property(lambda self: next((s for s, _ in self.found), None))
    top_file = property(lambda self: next((f for _, f in self.found), None))

    def line(self) -> str:
        digits = {"ts": 3, "latency_ms": 1}
        record = {f.name: getattr(self, f.name) for f in SCHEMA.fields}
        return json.dumps({k: round(v, digits[k]) if k in digits else v for k, v in record.items()}, ensure_ascii=False)


class RecallLog:
    """Appends recalls to the log of ``path`` in lines; without a path nothing is kept.

    A write that fails is dropped: a recall must not fail because its log does. Lines end up whole even if several
    processes write, as each batch is one write to a file opened for appending.
    """

    def __init__(self, path: str | None):
        self.path = path

    @classmethod
    def configured(cls) -> RecallLog:
        """The log that the environment names: ``off``, ``0`` or ``false`` for none, nothing for the one in the user's cache."""
        setting = os.environ.get(LOG_ENV, "")
        if setting in {"off", "0", "false"}:
            return cls(None)
        return cls(os.path.expanduser(setting or os.path.join(cache_home(), "query-log.jsonl")))

    def append(self, *recalls: Recall) -> None:
        if self.path is None or not recalls:
            return
        try:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(self.path, "ab") as f:
                f.write("".join(r.line() + "\n" for r in recalls).encode("utf-8", "surrogatepass"))
        except (OSError, ValueError, TypeError):
            pass


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed lines of a log (a file, or a folder of rotated files), with ``line_no`` in the order of the log.

    Files follow each other by time of last change, then name. Within a file lines are ordered by the offset of
    their split, then by place in it; a split of an offset never has as many lines as the bytes to the next.
    """
    with_bad = T.StructType([*SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", *[F.col(f"_metadata.file_{c}").alias(f"_{c}") for c in ("path", "modification_time", "block_start")])
    place = F.col("_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    files = rows.select("_path", "_modification_time").distinct()
    rows = rows.withColumn("_place", place).where(F.col("_corrupt_record").isNull())
    order = F.row_number().over(W.orderBy("_modification_time", "_path")) - 1  # one row a file
    rows = rows.join(files.select("_path", order.alias("_file")), "_path")
    line = F.shiftleft(F.col("_file").cast("long"), 44) + F.col("_place")
    return rows.select(*[f.name for f in SCHEMA.fields], line.alias("line_no"))
