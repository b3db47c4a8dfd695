"""The engine over real directories: incrementality, snapshots, resilience, log, command line, tool server."""

import io
import json
import os
import threading

import pytest

from memweft import RecallConfig, server
from memweft.sources.querylog import RecallLog
from memweft.vault import Vault


@pytest.fixture
def make(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MEMWEFT_LOG", str(tmp_path / "log.jsonl"))

    def build(files, name="notes", **config):
        root = tmp_path / name
        for path, text in files.items():
            p = root / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return Vault(str(root), RecallConfig(model="signed-hash-64", dim=64, db_dir=str(tmp_path / "db"), **config), spark)

    return build


def write(vault, path, text, mtime=None):
    p = os.path.join(vault.dir, path)
    with open(p, "w") as f:
        f.write(text)
    if mtime:
        os.utime(p, (mtime, mtime))


def test_index_edit_delete(make):
    v = make({"a.md": "Backup recovery of the garden.\n\nSecond part.", "_b.md": "Shopping list with pears.", ".c.md": "hidden", "d.txt": "no", "e.md": b"bad \xff byte\r\nnext line"})
    assert v.search("anything") == []
    assert v.reindex() == {"files_total": 3, "files_reindexed": 3, "chunks": 3, "embedded": 3, "cached": 0}
    assert v.reindex() == {"files_total": 3, "files_reindexed": 0, "chunks": 0, "embedded": 0, "cached": 0}
    hit = v.search("backup recovery")[0]
    assert hit["file"] == "a.md" and hit["text"] == hit["snippet"] == "Backup recovery of the garden.\n\nSecond part."
    assert [h["text"] for h in v.search("next line") if h["file"] == "e.md"] == ["bad  byte\nnext line"]
    write(v, "_b.md", "A new topic: volcano.", 1_000_000_000.25)
    os.remove(os.path.join(v.dir, "e.md"))
    got = v.reindex()
    assert (got["files_total"], got["files_reindexed"], got["embedded"]) == (2, 1, 1)
    hits = v.search("volcano")
    assert hits[0]["file"] == "_b.md" and not any("byte" in h["text"] for h in hits)
    assert [h for h in v.search("backup recovery") if h["file"] == "a.md"][0]["id"] == hit["id"]
    assert v.stats()["files"] == 2 and not v.index_path.startswith(v.dir)
    full = v.reindex(full=True)
    assert full["files_reindexed"] == 2 and full["embedded"] == 0 and full["cached"] == 2
    # the log has a line for each search
    lines = [json.loads(x) for x in open(RecallLog.configured().path)]
    assert len(lines) == 5 and lines[0]["empty"] and lines[1]["top_file"] == "a.md"


def test_tree_frontmatter_ignore_and_copies(make):
    v = make({"p/T.md": "---\ntag: canary\n---\nSame text.", "q/T.md": "Same text.", ".x/z.md": "no", "tmp/t.md": "no"}, recursive=True, strip_frontmatter=True, ignore_globs=("tmp/*",))
    assert v.reindex() == {"files_total": 2, "files_reindexed": 2, "chunks": 2, "embedded": 1, "cached": 1}
    assert {h["file"] for h in v.search("same text")} == {"p/T.md", "q/T.md"}
    assert not any("canary" in h["text"] for h in v.search("canary"))


def test_model_switch_and_failed_rebuild(make, spark, monkeypatch):
    v = make({"a.md": "alpha"})
    v.reindex()
    other = Vault(v.dir, RecallConfig(model="signed-hash-32", dim=32, db_dir=v.config.db_dir), spark)
    with pytest.raises(ValueError):
        other.search("alpha")
    import memweft.plans.index as index

    monkeypatch.setattr(index.SnapshotStore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        other.reindex()
    monkeypatch.undo()
    assert v.search("alpha")[0]["file"] == "a.md"  # the old index still serves
    assert other.reindex()["embedded"] == 1 and other.search("alpha")[0]["file"] == "a.md"


def test_damaged_index_heals(make):
    v = make({"a.md": "alpha"})
    v.reindex()
    for root, _, names in os.walk(v.store.path(v.store.current()["version"], "chunks")):  # every bucket
        for n in names:
            os.remove(os.path.join(root, n))
    assert v.search("alpha") == []
    for t in threading.enumerate():
        if t.daemon and t.name.endswith("(run)"):
            t.join(90)
    assert v.search("alpha")[0]["file"] == "a.md"


def test_concurrent_writers(make, spark):
    v = make({"a.md": "alpha"})
    v.reindex()
    w = Vault(v.dir, v.config, spark)
    errors = []

    def run(vault, k):
        try:
            write(vault, f"n{k}.md", f"note {k}")
            vault.reindex()
        except Exception as e:
            errors.append(e)

    ts = [threading.Thread(target=run, args=(x, k)) for k, x in enumerate((v, w))]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert not errors and v.stats()["files"] == 3


def test_tool_server_and_command_line(make, capsys, monkeypatch, tmp_path):
    v = make({"a.md": "alpha note"})
    monkeypatch.setattr("memweft.vault.default_session", lambda: v.spark)
    calls = [{"method": "initialize", "id": 1}, {"method": "notifications/initialized"}, {"method": "tools/list", "id": 2}, {"method": "tools/call", "id": 3, "params": {"name": "memory_record", "arguments": {"content": "The comet passes in May.", "title": "Comet"}}}, {"method": "tools/call", "id": 4, "params": {"name": "memory_recall", "arguments": {"query": "comet", "limit": 1}}}, {"method": "tools/call", "id": 5, "params": {"name": "nope"}}, {"method": "tools/call", "id": 6, "params": {"name": "memory_recall", "arguments": {}}}, {"method": "what", "id": 7}]
    out = io.StringIO()
    server.serve(v.dir, v.config, v.spark, ["", "not json", *map(json.dumps, calls)], out)
    r = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert set(r) == {1, 2, 3, 4, 5, 6, 7} and len(r[2]["result"]["tools"]) == 2
    assert json.loads(r[3]["result"]["content"][0]["text"])["status"] == "ok"
    assert "The comet passes in May." in r[4]["result"]["content"][0]["text"]
    assert r[5]["error"]["code"] == r[7]["error"]["code"] == -32601 and r[6]["error"]["code"] == -32000
    from memweft import cli

    assert cli.main([]) == 1
    assert cli.analyze(None, True, v.spark) == 0 and '"recalls": 1' in capsys.readouterr().out
    assert cli.analyze("other", False, v.spark) == 0 and "No recall events match." in capsys.readouterr().out
    monkeypatch.setenv("MEMWEFT_LOG", "off")
    assert RecallLog.configured().path is None and cli.analyze(None, False, v.spark) == 0
    assert "No query log yet" in capsys.readouterr().out


def test_single_search_equals_the_plan(make, spark):
    """The index in memory and the distributed plan give the same hits, with ages, phrases and odd queries."""
    files = {f"n{i:02d}.md": "\n\n".join(f"note {i} about {w} snake_case_{i % 3} Ünïcode {w * (i % 4)}" for w in ("garden", "river", "stone")[: 1 + i % 3]) for i in range(40)}
    v = make({**files, "MEMORY.md": "garden of stones"}, half_life_days=20.0, chunk_chars=60)
    for i in range(40):
        os.utime(os.path.join(v.dir, f"n{i:02d}.md"), (1_700_000_000 + i * 86400.5,) * 2)
    v.reindex(now=1_800_000_000.0)
    asked = ["garden stone", "snake_case_1", "UNICODE river", "the of and", "_", "", "nothing here", "note 7 about"]
    rows = v.recall(spark.createDataFrame([(i, q, 4) for i, q in enumerate(asked)], "qid long, query string, k int")).orderBy("qid", "pos").collect()
    want = {i: [(r["id"], r["score"], r["file"], r["snippet"]) for r in rows if r["qid"] == i] for i in range(len(asked))}
    assert {i: [(h["id"], h["score"], h["file"], h["snippet"]) for h in v.search(q, 4)] for i, q in enumerate(asked)} == want
    import memweft.vault as V

    old, V.MOST_BYTES = V.MOST_BYTES, 0  # an index too large for memory
    try:
        v._local = (0, None)
        assert [h["id"] for h in v.search(asked[0], 4)] == [x[0] for x in want[0]] and v._local[1] is None
    finally:
        V.MOST_BYTES = old


def test_hostile_queries(make):
    v = make({"a.md": 'def f(x): return {"key": x[0]} # OR AND NEAR'})
    v.reindex()
    for q in ('"unbalanced', "a OR AND NEAR(b", "key: [x] {y}", "*", "' ; drop", "\x00", "x" * 5000, "AND", "-- /* */"):
        assert isinstance(v.search(q), list)
    assert v.search("def f return key")[0]["file"] == "a.md"


def test_lost_index_is_rebuilt(make):
    import shutil

    v = make({"a.md": "alpha"})
    v.reindex()
    shutil.rmtree(v.index_path)
    os.makedirs(v.index_path)
    assert v.search("alpha") == []
    assert v.reindex(full=True)["files_reindexed"] == 1 and v.search("alpha")[0]["file"] == "a.md"


def test_no_empty_read_while_the_index_changes(make):
    v = make({f"n{i}.md": f"common topic {i}" for i in range(8)})
    v.reindex()
    reader = Vault(v.dir, v.config, v.spark)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set() or len(seen) < 20:
            seen.append(len(reader.search("common topic", 3)))

    t = threading.Thread(target=read)
    t.start()
    for i in range(3):
        write(v, f"n{i}.md", f"common topic changed {i}")
        v.reindex()
    stop.set()
    t.join(120)
    assert len(seen) >= 20 and min(seen) == 3


def test_only_touched_buckets_are_rewritten(make, monkeypatch):
    import memweft.plans.index as index

    monkeypatch.setattr(index, "FILES", 3)
    monkeypatch.setattr(index, "FOLDERS", 2)
    v = make({f"n{i}.md": f"topic {i}" for i in range(12)})
    v.reindex()
    before = v.store.current()
    assert before["buckets"] == 4
    for k in range(4):
        write(v, "n3.md", f"other {k}", 1_000_000_000 + k)
        v.reindex()
        meta = v.store.current()
        changed = [b for b in meta["tables"]["chunks"] if meta["tables"]["chunks"][b] != before["tables"]["chunks"].get(b)]
        assert len(changed) == 1 and len(meta["tables"]["emb_cache"]) <= 3
        before = meta
        assert v.search(f"other {k}")[0]["file"] == "n3.md" and v.stats() == {"files": 12, "chunks": 12, "index": v.index_path}
    kept = {f.split("/")[0] for t in before["tables"].values() for f, _ in t.values()}
    assert kept <= {d for d in os.listdir(v.index_path) if d.startswith("v=")}


WRITER = """
import os, sys
sys.path.insert(0, sys.argv[1])
os.environ["PYTHONPATH"] = sys.argv[1]
os.environ["MEMWEFT_LOG"] = "off"
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.driver.memory", "700m").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from memweft import RecallConfig, Vault
v = Vault(sys.argv[2], RecallConfig(model="signed-hash-64", dim=64, db_dir=sys.argv[3]), spark)
for i in range(2):
    with open(os.path.join(v.dir, f"p{sys.argv[4]}-{i}.md"), "w") as f:
        f.write(f"written by {sys.argv[4]} at {i}")
    v.reindex()
"""


def test_writers_in_three_processes(make, tmp_path):
    import subprocess
    import sys

    v = make({f"n{i}.md": f"note {i}" for i in range(10)})
    v.reindex()
    script = tmp_path / "writer.py"
    script.write_text(WRITER)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ps = [subprocess.Popen([sys.executable, str(script), root, v.dir, v.config.db_dir, str(k)], stdout=subprocess.DEVNULL, stderr=subprocess.PIPE) for k in range(3)]
    for p in ps:
        _, err = p.communicate(timeout=300)
        assert p.returncode == 0, err[-2000:]
    v.reindex()
    assert v.stats()["files"] == 16 and v.search("written by 2", 8)[0]["file"].startswith("p2")


def test_many_searches_are_one_plan(make, monkeypatch):
    """An index too large for memory is searched once for all questions; hits are those of single searches, and all are logged."""
    import memweft.vault as V

    v = make({f"n{i:02d}.md": f"note {i} about {w}" for i, w in enumerate(["garden", "river", "stone"] * 6)})
    v.reindex()
    asked = ["garden note", None, "river", "garden note", "", "nothing here"]
    want = [v.search(q, 3) for q in asked]
    monkeypatch.setattr(V, "MOST_BYTES", 0)
    v._local, runs, one = (0, None), [], v.recall
    monkeypatch.setattr(v, "recall", lambda q: runs.append(1) or one(q))
    assert list(v.search_all(asked, 3)) == want and len(runs) == 1
    assert len(open(RecallLog.configured().path).readlines()) == 2 * len(asked)
    out = io.StringIO()
    call = lambda i, q, name="memory_recall": json.dumps({"id": i, "method": "tools/call", "params": {"name": name, "arguments": {"query": q, "content": q}}})
    server.answer(v, [call(1, "garden note"), "no json", call(2, "river"), call(3, None), call(4, "The comet passes.", "memory_record"), call(5, "comet")], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5] and len(runs) == 4  # two together, the null by itself, one after the record
    assert "The comet passes." in replies[4]["result"]["content"][0]["text"] and "garden" in replies[0]["result"]["content"][0]["text"]


def test_index_of_a_table_is_that_of_its_files(make, spark):
    """Notes of a table give the chunks, terms and hits of the same notes as files, of which none is written."""
    from memweft.sources.markdown import write_notes

    rows = [("a.md", "one\r\n\r\ntwo\rthree\n\none", 1e9), ("d/.b.md", "alpha", 1e9), (".x/c.md", "no", 1e9), ("t.txt", "no", 1e9), ("tmp/t.md", "no", 1e9), ("e.md", "", 1e9), ("n.md", None, 1e9)]
    notes = spark.createDataFrame(rows, "path string, text string, mtime double")
    v = make({}, recursive=True, ignore_globs=("tmp/*",), chunk_chars=5)
    write_notes(notes, v.dir)
    w = Vault(v.dir + "-table/notes", v.config, spark, notes)
    assert v.reindex(now=2e9) == w.reindex(now=2e9) == {"files_total": 3, "files_reindexed": 3, "chunks": 3, "embedded": 3, "cached": 0}
    assert w.reindex(now=2e9)["files_reindexed"] == 0 and os.listdir(w.dir) == []
    of = lambda x: sorted(map(tuple, x.snapshot().chunks.drop("fresh").collect()))
    occ = lambda x: sorted(map(tuple, x.snapshot().occ.collect()))
    assert of(v) == of(w) and occ(v) == occ(w) and v.search("alpha one") == w.search("alpha one")
    w.notes = notes.where("path <> 'a.md'").union(spark.createDataFrame([("f.md", "new", 1e9)], notes.schema))
    assert w.reindex(now=2e9)["embedded"] == 1 and {x[2] for x in of(w)} == {"d/.b.md", "f.md"}


def test_index_has_a_row_of_terms_for_each_chunk(make, spark):
    v = make({"a.md": "word " * 1000})
    v.reindex()
    rows = sum(spark.read.parquet(f).count() for f, _ in v.snapshot().folders("occurrences"))
    assert rows == 1 and v.snapshot().occ.count() == 1000
