"""Processing only new or changed records: a high-watermark over a monotonic commit sequence.

``IncrementalRun`` is the durable operator: a run reads the watermark of the last one as its lower bound, fixes the
upper limits of what it reads when it starts, reads only what lies between, and publishes its output, the state it
leaves and the new watermark by one atomic rename. ``snapshot_diff`` compares whole tables without a state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import CommitLog


def committed_runs(runs: DataFrame, upper: int | None = None) -> DataFrame:
    """``run_id`` of successful runs up to ``upper``: status ``committed`` in any letter case; null means killed."""
    ok = runs.where((F.lower("status") == "committed") & F.col("run_id").isNotNull())
    if upper is not None:
        ok = ok.where(F.col("run_id") <= F.lit(upper))
    return ok.select("run_id").distinct()


def fix_upper(runs: DataFrame) -> int:
    """The upper limit of this run: the largest committed run when it starts (0 if there is none)."""
    return committed_runs(runs).agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("u")).first()["u"]


def current_state(files: DataFrame, upper_time=None) -> DataFrame:
    """(tenant, path, mtime, listed_at) as last listed among rows that have an mtime.

    Rows with a null tenant or path name no file and are left out. A null ``listed_at`` counts as
    the earliest listing. Of equal times the larger mtime wins, so repeated rows change nothing.
    ``upper_time`` bounds the listing, again fixed when a run starts.
    """
    seen = files.where(F.col("mtime").isNotNull() & F.col("tenant").isNotNull() & F.col("path").isNotNull())
    if upper_time is not None:
        seen = seen.where(F.col("listed_at").isNull() | (F.col("listed_at") <= F.lit(upper_time)))
    # max over a struct is partially aggregated before the shuffle; nulls order first in it
    last = F.max(F.struct(F.col("listed_at").alias("t"), F.col("mtime").alias("m")))
    return seen.groupBy("tenant", "path").agg(last.alias("s")).select("tenant", "path", F.col("s.m").alias("mtime"), F.col("s.t").alias("listed_at"))


def known_state(manifest: DataFrame, runs: DataFrame, upper: int | None = None) -> DataFrame:
    """(tenant, path, known_run, known_mtime): the last successful note of each file up to ``upper``.

    A null ``known_mtime`` says that the file was removed from the index.
    """
    noted = manifest.where(F.col("tenant").isNotNull() & F.col("path").isNotNull()).join(committed_runs(runs, upper), "run_id", "left_semi")
    last = F.max(F.struct(F.col("run_id").alias("r"), F.col("mtime").alias("m")))
    return noted.groupBy("tenant", "path").agg(last.alias("s")).select("tenant", "path", F.col("s.r").alias("known_run"), F.col("s.m").alias("known_mtime"))


def snapshot_diff(files: DataFrame, manifest: DataFrame, runs: DataFrame, upper: int | None = None) -> DataFrame:
    """Every known or listed file once, with ``state`` in new, changed, unchanged, deleted.

    mtimes are compared exactly, older ones included. A file that was removed from the index and is
    listed again is new. Files that neither exist nor are known do not come out.
    """
    now = current_state(files).select("tenant", "path", "mtime")
    known = known_state(manifest, runs, upper).select("tenant", "path", "known_mtime")
    both = now.join(known, ["tenant", "path"], "full_outer")
    state = (
        F.when(F.col("mtime").isNull() & F.col("known_mtime").isNull(), None)
        .when(F.col("mtime").isNull(), "deleted")
        .when(F.col("known_mtime").isNull(), "new")
        .when(F.col("mtime") == F.col("known_mtime"), "unchanged")
        .otherwise("changed")
    )
    return both.withColumn("state", state).where(F.col("state").isNotNull())


def changed_files(files: DataFrame, manifest: DataFrame, runs: DataFrame, upper: int | None = None) -> DataFrame:
    """(tenant, path, mtime) of the files to process: added or changed since their last successful note."""
    return snapshot_diff(files, manifest, runs, upper).where(F.col("state").isin("new", "changed")).select("tenant", "path", "mtime")


#: Files that one bucket of the state should hold, and the most buckets.
BUCKET, MOST_BUCKETS = 250_000, 4096
KNOWN = "struct<run:bigint,step:bigint,mtime:double>"


class IncrementalRun:
    """Exactly-once processing of changed files over a state folder on a shared file system.

    The state has a row for each file: its latest listing, and what is known of it, in buckets by hash of tenant and
    path. A step reads of the listing only rows from the last step's upper time on (rows without a time are the
    earliest and always looked at), of an earlier system's commit log only notes of runs above the last step's
    highest run, and of the state only the buckets these touch; it rewrites no others. Runs up to the mark that hadn't
    succeeded are kept in it by number, so that one that commits late is still read. Rows at a limit may be read twice,
    which changes nothing, as the state keeps maxima.

    Output, state and mark become current together when the step's entry in the commit log appears. A step that dies
    before leaves nothing that a later one reads, so nothing is skipped and nothing comes out twice; of two steps that
    race for a number one raises ``Conflict``. Listing rows must not arrive with a time below the mark.
    """

    def __init__(self, spark, root: str, buckets: int | None = None):
        self.spark, self.buckets, self.log = spark, buckets, CommitLog(spark, root)

    def watermark(self) -> dict | None:
        """The last committed entry: its number, the highest run and listing time read, runs still open, and folders."""
        return self.log.last()

    def _state_schema(self, time_type: str) -> str:
        return f"tenant string, path string, seen struct<t:{time_type},m:double>, known {KNOWN}, due boolean"

    def _state(self, mark: dict, buckets) -> DataFrame:
        paths = [self.log.at(f"{mark['parts'][str(b)]}/state/bucket={b}") for b in buckets if str(b) in mark["parts"]]
        schema = self._state_schema(mark["time_type"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """(tenant, path, seen, known, due) of every file, as of the last committed step; due: processed by its last step."""
        mark = self.watermark()
        return self._state(mark, range(mark["buckets"])) if mark else self.spark.createDataFrame([], self._state_schema("timestamp"))

    def output(self, entry: dict) -> DataFrame:
        """What a committed step put out."""
        return self.spark.read.parquet(self.log.at(f"{entry['folder']}/output"))

    def outputs(self) -> list[str]:
        """Folders of all committed outputs, oldest first."""
        entries = map(self.log.read, self.log.numbers())
        return [self.log.at(f"{e['folder']}/output") for e in entries if e["has_output"]]

    def adopt(self, manifest: DataFrame, runs: DataFrame) -> dict:
        """Take over what an earlier system's commit log says of the files: its successful notes since the mark."""
        return self._advance(None, None, manifest, runs)

    def step(self, files: DataFrame, process=lambda due: due, manifest: DataFrame | None = None, runs: DataFrame | None = None) -> dict:
        """One run over a listing: ``process`` maps the due (tenant, path, mtime) rows to the output. Returns its entry."""
        return self._advance(files, process, manifest, runs)

    def _advance(self, files, process, manifest, runs) -> dict:
        mark = self.watermark() or {"number": 0, "run": None, "listed": None, "open": [], "parts": {}, "buckets": self.buckets, "time_type": None}
        number, low, listed = mark["number"] + 1, mark["run"], mark["listed"]
        time_type = mark["time_type"] or (files.schema["listed_at"].dataType.simpleString() if files is not None else "timestamp_ntz")
        # the upper limits, before anything else is read
        run, still_open = low, mark["open"]
        if runs is not None:
            run = max(committed_runs(runs).agg(F.max("run_id")).first()[0] or 0, low or 0)
            ok = committed_runs(runs).withColumn("ok", F.lit(True))
            ids = runs.where(F.col("run_id") <= run).select("run_id").distinct().join(ok, "run_id", "left").where("ok IS NULL")
            still_open = sorted(r["run_id"] for r in ids.collect())  # a number for each run that hasn't succeeded
        upper = files.agg(F.max("listed_at").cast("string")).first()[0] if files is not None else None

        empty = lambda t: F.lit(None).cast(t)
        seen_type = f"struct<t:{time_type},m:double>"
        rows = []
        named = F.col("tenant").isNotNull() & F.col("path").isNotNull()
        if files is not None:
            at = F.col("listed_at").cast(time_type)
            between = at <= F.lit(upper).cast(time_type)
            between = between & (at >= F.lit(listed).cast(time_type)) if listed is not None else between
            fresh = files.where(named & F.col("mtime").isNotNull() & (F.col("listed_at").isNull() | between))
            rows.append(fresh.select("tenant", "path", F.struct(at.alias("t"), F.col("mtime").alias("m")).cast(seen_type).alias("seen"), empty(KNOWN).alias("known")))
        if manifest is not None:
            window = F.col("run_id") <= run
            if low is not None:
                window = window & ((F.col("run_id") > low) | F.col("run_id").isin(mark["open"] or [-1]))
            notes = manifest.where(named & window).join(F.broadcast(committed_runs(runs)), "run_id", "left_semi")  # a number a run
            note = F.struct(F.col("run_id").cast("long").alias("run"), F.lit(0).cast("long").alias("step"), F.col("mtime").alias("mtime"))
            rows.append(notes.select("tenant", "path", empty(seen_type).alias("seen"), note.cast(KNOWN).alias("known")))
        fresh = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        buckets = mark["buckets"] or min(MOST_BUCKETS, max(8, -(-fresh.count() // BUCKET)))
        bucket = F.pmod(F.xxhash64("tenant", "path"), F.lit(buckets)).cast("int")
        fresh = fresh.withColumn("bucket", bucket)
        if mark["parts"]:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
            fresh = fresh.unionByName(self._state(mark, touched).select("tenant", "path", "seen", "known").withColumn("bucket", bucket))
        # one shuffle, by bucket, serves the merge and the write
        merged = fresh.repartition("bucket").groupBy("bucket", "tenant", "path").agg(F.max("seen").alias("seen"), F.max("known").alias("known"))
        due = F.lit(files is not None) & F.col("seen").isNotNull() & ~F.col("seen.m").eqNullSafe(F.col("known.mtime"))
        ours = F.struct(F.lit(run or 0).cast("long").alias("run"), F.lit(number).cast("long").alias("step"), F.col("seen.m").alias("mtime"))
        merged = merged.withColumn("due", due).withColumn("known", F.when(F.col("due"), ours).otherwise(F.col("known")))
        folder = self.log.folder()
        try:
            merged.write.partitionBy("bucket").parquet(self.log.at(f"{folder}/state"))
            written = self.spark.read.schema(self._state_schema(time_type) + ", bucket int").parquet(self.log.at(f"{folder}/state"))
            parts = {str(r["bucket"]): folder for r in written.select("bucket").distinct().collect()}  # at most MOST_BUCKETS
            if process is not None:
                process(written.where("due").select("tenant", "path", F.col("seen.m").alias("mtime"))).write.parquet(self.log.at(f"{folder}/output"))
            entry = {"run": run, "listed": max(filter(None, (upper, listed)), default=None), "open": still_open, "parts": {**mark["parts"], **parts}, "buckets": buckets, "time_type": time_type, "folder": folder, "has_output": process is not None}
            return self.log.commit(number, entry)
        except BaseException:
            self.log.discard(folder)
            raise
