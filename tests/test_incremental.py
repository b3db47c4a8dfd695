import datetime as dt

import pytest

from memweft.operators import incremental as I

FILES = "tenant string, path string, mtime double, n_bytes long, listed_at timestamp, state string, known_mtime double"
T0 = dt.datetime(2025, 1, 1)


def files(spark, rows):
    return spark.createDataFrame([(*r[:3], None, r[3], "clash", 1.0) for r in rows], FILES)


def test_states(spark):
    f = files(spark, [("t", "new", 1.0, T0), ("t", "old", 1.0, T0), ("t", "old", 2.0, T0 + dt.timedelta(1)), ("t", "old", None, T0 + dt.timedelta(2)), ("t", "same", 1.5, T0), ("t", "same", 1.5, T0), ("t", "unread", None, T0), ("t", "back", 3.0, None), (None, "x", 1.0, T0), ("t", None, 1.0, T0), ("t", "killed", 1.0, T0), ("t", "older", 0.5, T0)])
    man = spark.createDataFrame([(1, "t", "old", 1.0), (1, "t", "same", 1.5), (1, "t", "same", 1.5), (2, "t", "back", None), (1, "t", "back", 3.0), (1, "t", "gone", 1.0), (3, "t", "killed", 1.0), (4, "t", "same", 9.0), (1, "t", "older", 1.0), (None, "t", "new", 1.0)], "run_id int, tenant string, path string, mtime double")
    runs = spark.createDataFrame([(1, "committed"), (2, "COMMITTED"), (3, None), (4, "failed")], "run_id int, status string")
    upper = I.fix_upper(runs)
    assert upper == 2
    got = {r["path"]: r["state"] for r in I.snapshot_diff(f, man, runs, upper).collect()}
    assert got == {"new": "new", "old": "changed", "same": "unchanged", "back": "new", "gone": "deleted", "killed": "new", "older": "changed"}
    assert {r["path"] for r in I.changed_files(f, man, runs, 1).collect()} == {"new", "old", "killed", "older"}
    none = I.changed_files(f.limit(0), man.limit(0), runs.limit(0), I.fix_upper(runs.limit(0)))
    assert none.count() == 0


def test_runs_skip_and_repeat_nothing(spark, tmp_path):
    run = I.IncrementalRun(spark, str(tmp_path), buckets=4)
    first = files(spark, [("t", f"p{i}", 1.0, T0) for i in range(5)])
    with pytest.raises(RuntimeError):
        run.step(first, lambda d: (_ for _ in ()).throw(RuntimeError("lost")))
    assert run.watermark() is None and run.outputs() == []
    run.step(first, lambda d: d)
    second = first.union(files(spark, [("t", "p1", 2.0, T0 + dt.timedelta(1)), ("t", "p9", 1.0, T0 + dt.timedelta(1))]))
    with pytest.raises(RuntimeError):
        run.step(second, lambda d: (_ for _ in ()).throw(RuntimeError("lost")))
    # another process opens the same folder
    run = I.IncrementalRun(spark, str(tmp_path))
    run.step(second, lambda d: d)
    run.step(second, lambda d: d)
    out = [sorted(r["path"] for r in spark.read.schema("path string").parquet(p).collect()) for p in run.outputs()]
    assert out == [[f"p{i}" for i in range(5)], ["p1", "p9"], []]
    assert run.step(first.limit(0))["number"] == 4 and run.state().count() == 6


@pytest.mark.parametrize("at", ["state", "output", "commit"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_crash_around_each_write(spark, tmp_path, monkeypatch, at, when):
    """A step that dies before its commit counts for nothing; one that dies after it has happened."""
    from pyspark.sql.readwriter import DataFrameWriter

    class Crash(BaseException):
        pass

    run = I.IncrementalRun(spark, str(tmp_path), buckets=2)
    run.step(files(spark, [("t", "a", 1.0, T0)]))
    more = files(spark, [("t", "a", 2.0, T0 + dt.timedelta(1)), ("t", "b", 1.0, T0 + dt.timedelta(1))])

    def dying(real):
        def call(self, *a, **k):
            hit = at == "commit" or str(a[0]).endswith(at)
            if hit and when == "before":
                raise Crash
            got = real(self, *a, **k)
            if hit:
                raise Crash
            return got

        return call

    if at == "commit":
        monkeypatch.setattr(I.CommitLog, "commit", dying(I.CommitLog.commit))
    else:
        monkeypatch.setattr(DataFrameWriter, "parquet", dying(DataFrameWriter.parquet))
    monkeypatch.setattr(I.CommitLog, "discard", lambda *a: None)  # the process is gone: nobody cleans up
    with pytest.raises(Crash):
        run.step(more)
    monkeypatch.undo()
    run = I.IncrementalRun(spark, str(tmp_path))
    done = at == "commit" and when == "after"
    assert run.watermark()["number"] == (2 if done else 1)
    run.step(more)
    got = [sorted((r["path"], r["mtime"]) for r in spark.read.parquet(p).collect()) for p in run.outputs()]
    assert got == [[("a", 1.0)], [("a", 2.0), ("b", 1.0)]] + ([[]] if done else [])


def test_only_one_of_two_racing_steps_commits(spark, tmp_path):
    from memweft.operators.commits import Conflict

    a, b = (I.IncrementalRun(spark, str(tmp_path), buckets=2) for _ in "ab")
    listing = files(spark, [("t", "a", 1.0, T0)])

    def slow(due):
        b.step(listing)
        return due

    with pytest.raises(Conflict):
        a.step(listing, slow)
    assert len(a.outputs()) == 1 and a.watermark()["number"] == 1


def test_lower_bounds_are_used(spark, tmp_path):
    """Rows below the mark aren't read again, runs that commit late are, and the state of other buckets stays as it was."""
    man = lambda rows: spark.createDataFrame(rows, "run_id int, tenant string, path string, mtime double")
    runs = lambda rows: spark.createDataFrame(rows, "run_id int, status string")
    run = I.IncrementalRun(spark, str(tmp_path), buckets=64)
    notes = [(1, "t", "a", 1.0), (2, "t", "b", 1.0), (3, "t", "c", 1.0), (3, "t", "a", 3.0)]
    run.adopt(man(notes), runs([(1, "committed"), (2, "running"), (3, "committed")]))
    assert run.watermark()["run"] == 3 and run.watermark()["open"] == [2]
    listing = files(spark, [("t", p, 1.0 if p != "a" else 3.0, T0) for p in "abc"])
    # run 2 commits late; a note of run 1 that turns up now lies below the mark and isn't read
    late = man([*notes, (1, "t", "z", 9.0)])
    entry = run.step(listing, manifest=late, runs=runs([(1, "committed"), (2, "committed"), (3, "committed")]))
    assert run.output(entry).count() == 0 and run.watermark()["open"] == []
    assert {r["path"] for r in run.state().collect()} == {"a", "b", "c"}
    before = run.watermark()["parts"]
    entry = run.step(listing.union(files(spark, [("t", "a", 4.0, T0 + dt.timedelta(1)), ("t", "b", 8.0, T0 - dt.timedelta(1))])))
    assert {tuple(r) for r in run.output(entry).collect()} == {("t", "a", 4.0)}
    later = files(spark, [("t", "d", 1.0, T0 + dt.timedelta(2))])
    entry = run.step(later)
    changed = [b for b, f in run.watermark()["parts"].items() if f == entry["folder"]]
    assert len(changed) == 1 and len(before) >= 2 and {tuple(r) for r in run.output(entry).collect()} == {("t", "d", 1.0)}


def test_stream_equals_table(spark, tmp_path):
    from memweft.streaming.log_stream import read_log_stream, windowed_recalls

    log = spark.read.parquet("/root/testdata/sf0.001/query_log.parquet").where("ts IS NOT NULL").drop("line_no")
    log.write.json(str(tmp_path / "in"))
    q = windowed_recalls(read_log_stream(spark, str(tmp_path / "in")), "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("recalls").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r["tenant"], r["start"]): r["recalls"] for r in df.collect()}
    assert key(spark.table("recalls")) == key(windowed_recalls(log, "1 day", "400 days"))


def test_log_reader_passes_over_bad_lines(spark, tmp_path):
    from memweft.sources.querylog import read_log

    p = tmp_path / "log.jsonl"
    p.write_text('{"event":"recall","tenant":"t","query":"a","latency_ms":1}\nnot json\n{"event":"other"}\n{"event":"recall","query":"b","top_score":null}\n')
    rows = read_log(spark, str(p)).orderBy("line_no").collect()
    assert [r["event"] for r in rows] == ["recall", "other", "recall"] and rows[2]["tenant"] is None


def test_log_of_rotated_files_is_read_in_order(spark, tmp_path):
    """Files are read largest first by Spark, but the order of the log is by time of change."""
    import json
    import os

    from memweft.operators import report
    from memweft.sources.querylog import read_log

    for k, n in enumerate((3, 400, 1)):
        p = tmp_path / f"log-{9 - k}.jsonl"
        p.write_text("".join(json.dumps({"event": "recall", "query": f"{k}-{i}", "empty": True}) + "\n" for i in range(n)))
        os.utime(p, (1_000_000 + k, 1_000_000 + k))
    rows = read_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["query"] for r in rows] == [f"{k}-{i}" for k, n in enumerate((3, 400, 1)) for i in range(n)]
    assert len({r["line_no"] for r in rows}) == 404
    assert [r["query"] for r in report.recent_misses(read_log(spark, str(tmp_path)), 2).collect()] == ["1-399", "2-0"]


def test_events_and_typed_lines_agree(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from memweft.sources import querylog as L

    queries = spark.createDataFrame([("t", 1, "a"), ("t", 2, None)], "tenant string, qid long, query string")
    hits = spark.createDataFrame([("t", 1, i, 1.0 / (i + 1), f"f{i}") for i in range(7)], "tenant string, qid long, pos int, score double, file string")
    rows = {r["qid"]: r for r in L.recall_events(queries, hits, F.lit(5.00049), F.lit(1.26)).collect()}
    assert rows[1]["n_results"] == 7 and len(rows[1]["scores"]) == L.HEAD and rows[1]["top_file"] == "f0" and not rows[1]["empty"]
    assert rows[2]["empty"] and rows[2]["scores"] == [] and rows[2]["top_score"] is None and rows[2]["latency_ms"] == 1.3
    log = L.RecallLog(str(tmp_path / "d" / "log.jsonl"))
    log.append(L.Recall("t", "a", tuple((1.0 / (i + 1), f"f{i}") for i in range(7)), 5.00049, 1.26))
    mine = json.loads(open(log.path).read())
    theirs = json.loads(L.recall_events(queries, hits, F.lit(5.00049), F.lit(1.26)).where("qid = 1").select(L.as_line().alias("value")).first()["value"])
    assert mine == theirs and list(mine) == [f.name for f in L.SCHEMA.fields]
    L.RecallLog(None).append(L.Recall("t", "a", (), 0.0, 0.0))
    L.RecallLog(str(tmp_path)).append(L.Recall("t", "a", (), 0.0, 0.0))  # a folder: dropped without an error


def test_medians_and_percentiles_match_sorted_lists(spark):
    from memweft.operators import report

    for n in (0, 1, 2, 3, 20, 21):
        vals = [float((i * 7) % 5) for i in range(n)]
        lines = spark.createDataFrame([(v, False, 1.0) for v in vals] + [(None, None, None)], "latency_ms double, empty boolean, top_score double")
        got = report.overall(lines).first()
        s = sorted(vals)
        assert got["latency_p50_ms"] == ((s[(n - 1) // 2] + s[n // 2]) / 2 if n else None)
        assert got["latency_p95_ms"] == (s[int(n * 0.95)] if n > 2 else None)


def test_neighbours_keep_any_id(spark):
    from memweft.operators.vectors import nearest

    big = 2**53
    base = spark.createDataFrame([("g", big + 1, [1.0, 0.0]), ("g", big + 3, [1.0, 0.0]), ("g", -big - 5, [0.0, 1.0]), ("g", None, [1.0, 0.0]), ("g", 7, None), (None, 8, [1.0, 0.0]), ("g", 9, [1.0])], "g string, id long, vec array<float>")
    asked = spark.createDataFrame([("g", big + 5, [1.0, 0.0]), ("g", big + 7, [0.0, 1.0]), ("g", 1, [2.0]), ("h", 2, [1.0, 0.0])], "g string, qid long, vec array<float>")
    got = {}
    for r in nearest(base, asked, "g", 2).orderBy("rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {big + 5: [big + 1, big + 3], big + 7: [-big - 5, big + 1], 1: [9]}
    words = base.selectExpr("g", "concat('x', id) as id", "vec")
    rows = nearest(words, asked.selectExpr("g", "cast(qid as string) as qid", "vec"), "g", 1).collect()
    assert {(r["qid"], r["id"]) for r in rows} == {(str(big + 5), f"x{big + 1}"), (str(big + 7), f"x{-big - 5}"), ("1", "x9")}
    assert nearest(base.limit(0), asked, "g", 2).count() == 0
