"""Queries over a vault of real files: every document is written as a note, indexed, changed, searched and served.

The vault is made once for each session and table folder, below the session's scratch folder; queries that change
something make one of their own.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import os
import shutil
from dataclasses import replace
from types import SimpleNamespace
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import cli, server
from ..config import LOG_ENV, RecallConfig
from ..operators import report
from ..session import materialize, scratch_dir, table
from ..sources import cards, querylog
from ..sources.markdown import read_vault, write_notes
from ..vault import Vault, index_name
from . import index
from .queries import BODY, HALF_LIFE, PARAS, fused_sql, mmr_sql, tokens_sql

#: The vault's settings, and the time at which ages are taken.
NOW = 1.8e9
CONFIG = RecallConfig(model="signed-hash-64", dim=64, recursive=True, strip_frontmatter=True, ignore_globs=("_drafts/*",), half_life_days=HALF_LIFE)
NAME = "notes"

_made: dict = {}


def _folder(spark) -> str:
    """A new local path in the scratch folder; notes are files, so it must be on a file system that is mounted everywhere."""
    where = urlparse(scratch_dir(spark))
    if where.scheme not in ("", "file"):
        raise RuntimeError("a vault needs a mounted file system")
    return where.path


def _notes(spark, sf) -> DataFrame:
    """(path, text, mtime) of every document that has a text; the time is one that a file system keeps exactly."""
    return table(spark, sf, "documents").select("path", "text", (F.lit(1.6e9) + F.col("doc_id") * 1.25).alias("mtime"))


def _fresh(spark, sf, config: RecallConfig = CONFIG) -> Vault:
    root = _folder(spark)
    os.makedirs(os.path.join(root, NAME))
    write_notes(_notes(spark, sf), os.path.join(root, NAME))
    return Vault(os.path.join(root, NAME), replace(config, db_dir=os.path.join(root, "index")), spark)


def _vault(spark, sf) -> Vault:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _made or _made[key].store.current() is None:
        v = _fresh(spark, sf)
        v.reindex(now=NOW)
        _made[key] = v
    return _made[key]


def _stored(spark, sf) -> Vault:
    """The same index made from the table itself, for queries that search it and don't touch the notes: a file takes a block of disk at least."""
    key = (spark.sparkContext.applicationId, sf, "table")
    if key not in _made or _made[key].store.current() is None:
        root = _folder(spark)
        v = Vault(os.path.join(root, NAME), replace(CONFIG, db_dir=os.path.join(root, "index")), spark, _notes(spark, sf))
        v.reindex(now=NOW)
        _made[key] = v
    return _made[key]


def _rows(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- sources -------------------------------------------------------------------------------------
def vault_flat(spark, sf) -> DataFrame:
    """Notes of the vault's own folder, read and decoded."""
    v = _vault(spark, sf)
    return read_vault(spark, v.dir).select("path", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "mtime")


def vault_tree(spark, sf) -> DataFrame:
    """Notes of all folders below but hidden ones."""
    v = _vault(spark, sf)
    return read_vault(spark, v.dir, recursive=True).select("tenant", "path", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- index ---------------------------------------------------------------------------------------
def vault_chunks(spark, sf) -> DataFrame:
    c = _vault(spark, sf).snapshot().chunks
    return c.select("path", "seq", "cid", "hash", F.md5("text").alias("text_md5"), F.round("age_days", 6).alias("age_days"), "evergreen", F.col("dl").cast("long").alias("dl"))


def vault_cache(spark, sf) -> DataFrame:
    return _vault(spark, sf).snapshot().cache.select("hash", "model", F.size("vec").alias("dim"))


def vault_vectors(spark, sf) -> DataFrame:
    """The vector of each chunk: how many slots it fills, and their sum."""
    snap = _vault(spark, sf).snapshot()
    vecs = index.chunk_vectors(snap.chunks, snap.cache, CONFIG.model)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vecs.select("cid", F.size(F.filter("vec", lambda x: x != 0)).alias("filled"), F.round(total, 4).alias("total"))


def vault_manifest(spark, sf) -> DataFrame:
    return _vault(spark, sf).snapshot().manifest.select("tenant", "path", "mtime")


def vault_terms(spark, sf) -> DataFrame:
    """The stored occurrences, by term."""
    return _vault(spark, sf).snapshot().occ.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("n_chunks"), F.max("pos").alias("last"))


def vault_counts(spark, sf) -> DataFrame:
    s = _vault(spark, sf).stats()
    return _rows(spark, [(s["files"], s["chunks"])], "files long, chunks long")


def vault_meta(spark, sf) -> DataFrame:
    """What the published version says of itself, and that nothing of it is missing."""
    v = _vault(spark, sf)
    meta = v.store.current()
    v.snapshot().check()
    return _rows(spark, [(meta["model"], meta["dim"], ",".join(sorted(meta["tables"])))], "model string, dim int, tables string")


def _edited(spark, sf):
    """A vault indexed, indexed again, then with a tenth of its notes gone and a tenth rewritten, and indexed a third time."""
    v = _fresh(spark, sf)
    runs = [v.reindex(now=NOW), v.reindex(now=NOW)]
    notes = table(spark, sf, "documents").where("path IS NOT NULL AND text IS NOT NULL")
    gone, root = notes.where("doc_id % 10 = 0").select("path"), v.dir

    def remove(batches):
        for pdf in batches:
            for p in pdf["path"]:
                os.remove(os.path.join(root, p))
            yield pdf

    gone.mapInPandas(remove, "path string").count()
    edits = notes.where("doc_id % 10 = 1").select("path", F.concat(F.lit("Edited note.\n\n"), "text").alias("text"), (F.lit(1.7e9) + F.col("doc_id") * 1.25).alias("mtime"))
    write_notes(edits, v.dir)
    runs.append(v.reindex(now=NOW))
    return v, runs


def vault_runs(spark, sf) -> DataFrame:
    """The counters of three runs of ``_edited``."""
    _, runs = _edited(spark, sf)
    names = ["files_total", "files_reindexed", "chunks", "embedded", "cached"]
    return _rows(spark, [(i + 1, *(r[n] for n in names)) for i, r in enumerate(runs)], "run int, " + ", ".join(f"{n} long" for n in names))


def vault_after_edits(spark, sf) -> DataFrame:
    """What the index holds after the edits, with each chunk's occurrences."""
    snap = _edited(spark, sf)[0].snapshot()
    n = snap.occ.groupBy("cid").agg(F.count(F.lit(1)).alias("n_terms"))
    return snap.chunks.join(n, "cid", "left").select("path", "cid", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def vault_switch(spark, sf) -> DataFrame:
    """Another model: searching before the index is made anew is an error, and nothing of the old model stays."""
    v = _fresh(spark, sf)
    v.reindex(now=NOW)
    other = Vault(v.dir, replace(v.config, model="signed-hash-32", dim=32), spark)
    try:
        other.search("note")
        refused = False
    except ValueError:
        refused = True
    made = other.reindex(now=NOW)
    cache = other.snapshot().cache.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model") != "signed-hash-32").alias("old")).first()
    return _rows(spark, [(refused, made["files_reindexed"], made["embedded"], cache["n"], cache["old"])], "refused boolean, files long, embedded long, vectors long, of_old_model long")


def vault_heal(spark, sf) -> DataFrame:
    """Index files are lost: a search finds nothing, the index is rebuilt in the background, once, and its vectors are kept."""
    v = _fresh(spark, sf)
    v.reindex(now=NOW)
    found = len(v.search("note of the team"))
    for folder, _ in v.snapshot().folders("occurrences"):
        shutil.rmtree(folder)
    lost = len(v.search("note of the team"))
    for _ in range(600):
        if v._healing.acquire(timeout=1):
            break
    v._healing.release()
    return _rows(spark, [(found, lost, len(v.search("note of the team")), len(v.store.current()["tables"]["emb_cache"]) > 1)], "before long, damaged long, healed long, cache_kept boolean")


# --- recall --------------------------------------------------------------------------------------
def _log(spark, sf) -> DataFrame:
    """(qid, query) of every recall in the log."""
    return table(spark, sf, "query_log").where("event = 'recall' AND tenant IS NOT NULL").select(F.col("line_no").alias("qid"), "query")


def _asked(spark, sf) -> DataFrame:
    return _log(spark, sf).where("qid % 100 = 0")


HITS = "qid long, pos int, id string, score double, file string"


def vault_recall(spark, sf) -> DataFrame:
    """A batch over the stored index: every recall of the log."""
    return _stored(spark, sf).recall(_log(spark, sf).withColumn("k", F.lit(5))).select(*[c.split()[0] for c in HITS.split(", ")])


@contextlib.contextmanager
def _logging_to(path: str):
    was = os.environ.get(LOG_ENV)
    os.environ[LOG_ENV] = path
    try:
        yield
    finally:
        os.environ.pop(LOG_ENV) if was is None else os.environ.__setitem__(LOG_ENV, was)


def vault_search(spark, sf) -> DataFrame:
    """Questions of the log as searches."""
    v = _stored(spark, sf)
    asked = _asked(spark, sf).collect()
    with _logging_to("off"):
        rows = [(r["qid"], i, h["id"], h["score"], h["file"]) for r, hits in zip(asked, v.search_all([r["query"] for r in asked], 5)) for i, h in enumerate(hits)]
    return _rows(spark, rows, HITS)


class _Digests(io.TextIOBase):
    """Takes replies line by line and keeps of each its number and the digest of its text."""

    def __init__(self):
        self.rows: list[tuple] = []

    def write(self, line: str) -> int:
        if line.strip():
            r = json.loads(line)
            self.rows.append((r["id"], hashlib.md5(r["result"]["content"][0]["text"].encode()).hexdigest()))
        return len(line)


def tool_replies(spark, sf) -> DataFrame:
    """The tool server over lines of requests: each question's reply as the text it sends."""
    v = _stored(spark, sf)
    asked = _asked(spark, sf).where("query IS NOT NULL").collect()
    lines = ["", "no json", "[1]", *(json.dumps({"jsonrpc": "2.0", "id": r["qid"], "method": "tools/call", "params": {"name": "memory_recall", "arguments": {"query": r["query"]}}}) for r in asked)]
    out = _Digests()
    with _logging_to("off"):
        server.answer(v, lines, out)
    return _rows(spark, out.rows, "qid long, text_md5 string")


def tool_protocol(spark, sf) -> DataFrame:
    """What the server says to requests without a search."""
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "other"}}, {"id": 4, "method": "other"}, {"id": 5, "method": "tools/call", "params": {"name": "memory_recall"}}]
    out = io.StringIO()
    server.answer(SimpleNamespace(), map(json.dumps, calls), out)
    rows = []
    for r in map(json.loads, out.getvalue().splitlines()):
        result = r.get("result", {})
        rows.append((r["id"], result.get("protocolVersion"), ",".join(t["name"] for t in result.get("tools", [])), r.get("error", {}).get("code")))
    return _rows(spark, rows, "id long, protocol string, tools string, error long")


def command_line(spark, sf) -> DataFrame:
    """What the commands print: index, stats, search and analyze over the vault and the log."""
    root = _folder(spark)
    notes = os.path.join(root, NAME)
    os.makedirs(notes)
    write_notes(_notes(spark, sf), notes)
    log = os.path.join(root, "log.jsonl")
    querylog.write_lines(table(spark, sf, "query_log").where("event = 'recall'"), log)
    keep, home = cli.session, os.environ.get("XDG_CACHE_HOME")
    os.environ["XDG_CACHE_HOME"] = os.path.join(root, "cache")
    cli.session = lambda: spark

    def printed(*argv) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out), _logging_to(log if argv[0] == "analyze" else "off"):
            cli.main(list(argv))
        return out.getvalue()

    try:
        made = json.loads(printed("index", "--tenant", notes, "--recursive", "--strip-frontmatter", "--ignore", "_drafts/*"))
        stats = printed("stats", "--tenant", notes).split()
        hits = json.loads(printed("search", "--tenant", notes, "--recursive", "-k", "3", "--json", "the"))
        report_ = json.loads(printed("analyze", "--json"))
    finally:
        cli.session = keep
        os.environ.pop("XDG_CACHE_HOME") if home is None else os.environ.__setitem__("XDG_CACHE_HOME", home)
    rows = [("index", "files_total", made["files_total"]), ("index", "chunks", made["chunks"]), ("stats", "files", int(stats[1])), ("stats", "chunks", int(stats[3])), ("search", "hits", len(hits)), ("analyze", "recalls", report_["recalls"]), ("analyze", "tenants", len(report_["by_tenant"]))]
    return _rows(spark, rows, "command string, name string, value long")


# --- log and cards -------------------------------------------------------------------------------
def log_round_trip(spark, sf) -> DataFrame:
    """Recalls made into events, written as lines of a log, read back by the log's reader, two batches in order."""
    lines = table(spark, sf, "query_log").where("event = 'recall' AND tenant IS NOT NULL")
    queries = lines.select("tenant", F.col("line_no").alias("qid"), "query", "ts", F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"))
    hits = lines.select("tenant", F.col("line_no").alias("qid"), "top_file", F.posexplode("scores").alias("pos", "score")).withColumn("file", F.when(F.col("pos") == 0, F.col("top_file")))
    path = scratch_dir(spark)
    timed = queries.withColumn("took", F.col("latency_ms"))
    querylog.write_lines(querylog.recall_events(timed, hits, F.col("ts"), F.col("took")), path)
    back = querylog.read_log(spark, path)
    order = F.row_number().over(W.partitionBy("tenant", "ts", "query").orderBy("latency_ms"))
    return back.select("ts", "tenant", "query", "n_results", "top_score", "top_file", F.size("scores").alias("n_scores"), "latency_ms", "empty", order.alias("nth"))


def log_paths(spark, sf) -> DataFrame:
    """Where the log is for each setting."""
    rows = []
    for setting in ("off", "0", "false", "/tmp/x.jsonl"):
        with _logging_to(setting):
            rows.append((setting, querylog.RecallLog.configured().path))
    with _logging_to(""):
        rows.append(("", os.path.basename(querylog.RecallLog.configured().path)))
    return _rows(spark, rows, "setting string, path string")


def card_files(spark, sf) -> DataFrame:
    """Every document as a card, written to files and read back as notes."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL AND created_at IS NOT NULL")
    facts = docs.select(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Card Nº "), "doc_id")).alias("title"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(F.concat("doc_id", F.lit(" "), "text")).alias("content"), F.col("created_at").alias("at"))
    root = _folder(spark)
    os.makedirs(root)
    cards.write_cards(facts, root).count()
    return read_vault(spark, root).select(F.col("path").alias("file"), F.md5("text").alias("body_md5"))


def tenant_order(spark, sf) -> DataFrame:
    """Tenants by number of recalls."""
    rows = materialize(report.busiest_tenants(report.recall_lines(table(spark, sf, "query_log"))))
    place = F.row_number().over(W.orderBy(F.desc("n"), "tenant"))  # a row a tenant
    return rows.select("tenant", "n", place.alias("place"))


def index_names(spark, sf) -> DataFrame:
    """The name of each tenant's index."""
    tenants = [r["tenant"] for r in table(spark, sf, "documents").where("tenant IS NOT NULL").select("tenant").distinct().collect()]  # a row a tenant
    return _rows(spark, [(t, index_name(f"/vaults/{t}/")) for t in tenants], "tenant string, name string")


QUERIES = {
    f.__name__: f
    for f in (
        vault_flat, vault_tree, vault_chunks, vault_cache, vault_vectors, vault_manifest, vault_terms, vault_counts, vault_meta, vault_runs, vault_after_edits, vault_switch, vault_heal,
        vault_recall, vault_search, tool_replies, tool_protocol, command_line, log_round_trip, log_paths, card_files, tenant_order, index_names,
    )
}

# --- SQL -----------------------------------------------------------------------------------------
_DECODED = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_FILES = f"""
  files_ AS (SELECT doc_id, path, {_DECODED.format("text")} AS text, 1.6e9::DOUBLE + doc_id * 1.25::DOUBLE AS mtime FROM documents WHERE text IS NOT NULL AND path IS NOT NULL AND path LIKE '%.md'),
  tree AS (SELECT * FROM files_ WHERE NOT regexp_matches(path, '(^|/)\\.[^/]*/')),
  notes AS (SELECT * FROM tree WHERE NOT path GLOB '_drafts/*')"""


def _cut(name: str, source: str) -> str:
    """CTEs from ``source`` (path, text, mtime) to ``name`` (path, hash, seq, cid, text, mtime): the first of equal chunks of each file."""
    return f"""
  {name}_p AS (SELECT path, mtime, {PARAS} AS p FROM (SELECT path, mtime, {BODY} AS body FROM {source})),
  {name}_f(path, mtime, p, i, cur, seq, done) AS (
    SELECT path, mtime, p, 1, '', 0, NULL::VARCHAR FROM {name}_p WHERE len(p) > 0
    UNION ALL
    SELECT path, mtime, p, i + 1,
      CASE WHEN i > len(p) THEN '' WHEN length(cur) + length(p[i]) < 1500 THEN CASE WHEN cur = '' THEN p[i] ELSE cur || chr(10) || chr(10) || p[i] END ELSE p[i] END,
      CASE WHEN done IS NULL THEN seq ELSE seq + 1 END,
      CASE WHEN i > len(p) OR length(cur) + length(p[i]) >= 1500 THEN nullif(cur, '') END
    FROM {name}_f WHERE i <= len(p) + 1),
  {name} AS MATERIALIZED (SELECT path, sha256(done) AS hash, min(seq)::INTEGER AS seq, sha256(path || chr(0) || sha256(done)) AS cid, any_value(done) AS text, any_value(mtime) AS mtime FROM {name}_f WHERE done IS NOT NULL GROUP BY path, sha256(done))"""


_CHUNKS = f"{_FILES}, {_cut('vchunks', 'notes')}"
_EVERGREEN = "regexp_matches(string_split(path, '/')[-1], '(?i)^(?:^(MEMORY|INDEX|.*reference_|.*architecture).*)')"
_LOG = f"""{_CHUNKS},
  docs AS MATERIALIZED (SELECT '{NAME}' AS tenant, cid, path, text, ({NOW!r}::DOUBLE - mtime) / 86400.0::DOUBLE AS age_days, {_EVERGREEN} AS evergreen FROM vchunks),
  asked AS (SELECT '{NAME}' AS tenant, line_no AS qid, query, top_file FROM query_log WHERE event = 'recall' AND tenant IS NOT NULL)"""
_VAULT_DOCS = _LOG.removesuffix(")") + " AND line_no % 100 = 0)"
_HITS = f"{mmr_sql(HALF_LIFE, fused_sql(_VAULT_DOCS))} SELECT s.qid, s.pos::INTEGER AS pos, c.cid AS id, round(c.score, 5) AS score, c.path AS file"
_EDITS = f"""{_FILES},
  left_ AS (SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'Edited note.' || chr(10) || chr(10) || text ELSE text END AS text, mtime, doc_id FROM notes WHERE doc_id % 10 <> 0),
  {_cut("first_", "notes")}, {_cut("last_", "left_")}"""

SQL = {
    "vault_flat": f"WITH {_FILES} SELECT path, length(text)::INTEGER AS n_chars, md5(text) AS text_md5, mtime FROM files_ WHERE NOT contains(path, '/') AND NOT starts_with(path, '.')",
    "vault_tree": f"WITH {_FILES} SELECT '{NAME}' AS tenant, path, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM tree",
    "vault_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT path, seq, cid, hash, md5(text) AS text_md5, round(({NOW!r}::DOUBLE - mtime) / 86400, 6) AS age_days, {_EVERGREEN} AS evergreen, coalesce(len({tokens_sql('text')}), 0)::BIGINT AS dl FROM vchunks",
    "vault_cache": f"WITH RECURSIVE {_CHUNKS} SELECT DISTINCT hash, 'signed-hash-64' AS model, 64::INTEGER AS dim FROM vchunks",
    "vault_vectors": f"{mmr_sql(HALF_LIFE, fused_sql(_VAULT_DOCS))} SELECT cid, len(list_filter(vec, lambda x: x <> 0))::INTEGER AS filled, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 4) AS total FROM dvec",
    "vault_manifest": f"WITH {_FILES} SELECT '{NAME}' AS tenant, path, mtime FROM notes",
    "vault_terms": f"WITH RECURSIVE {_CHUNKS} SELECT term, count(*) AS n, count(DISTINCT cid) AS n_chunks, max(pos)::INTEGER AS last FROM (SELECT cid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT cid, {tokens_sql('text')} AS t FROM vchunks)) GROUP BY term",
    "vault_counts": f"WITH RECURSIVE {_CHUNKS} SELECT count(DISTINCT path) AS files, count(*) AS chunks FROM vchunks",
    "vault_meta": "SELECT 'signed-hash-64' AS model, 64::INTEGER AS dim, 'chunks,emb_cache,manifest,occurrences' AS tables",
    "vault_runs": f"""WITH RECURSIVE {_EDITS},
  new_ AS (SELECT * FROM last_ WHERE path IN (SELECT path FROM left_ WHERE doc_id % 10 = 1)),
  n AS (SELECT (SELECT count(*) FROM notes) AS files, (SELECT count(*) FROM first_) AS c, (SELECT count(DISTINCT hash) FROM first_) AS e,
    (SELECT count(*) FROM left_) AS files3, (SELECT count(*) FROM left_ WHERE doc_id % 10 = 1) AS due3, (SELECT count(*) FROM new_) AS c3, (SELECT count(DISTINCT hash) FROM new_ WHERE hash NOT IN (SELECT hash FROM first_)) AS e3)
SELECT 1::INTEGER AS run, files AS files_total, files AS files_reindexed, c AS chunks, e AS embedded, c - e AS cached FROM n
UNION ALL SELECT 2, files, 0, 0, 0, 0 FROM n UNION ALL SELECT 3, files3, due3, c3, e3, c3 - e3 FROM n""",
    "vault_after_edits": f"WITH RECURSIVE {_EDITS} SELECT path, cid, coalesce(len({tokens_sql('text')}), 0)::BIGINT AS n_terms FROM last_",
    "vault_switch": f"WITH RECURSIVE {_CHUNKS} SELECT true AS refused, (SELECT count(*) FROM notes) AS files, count(DISTINCT hash) AS embedded, count(DISTINCT hash) AS vectors, 0::BIGINT AS of_old_model FROM vchunks",
    "vault_heal": "SELECT 5::BIGINT AS before, 0::BIGINT AS damaged, 5::BIGINT AS healed, true AS cache_kept",
    "vault_recall": f"{_HITS.replace(_VAULT_DOCS, _LOG)} FROM steps s JOIN cand c ON s.qid = c.qid AND s.i = c.i",
    "vault_search": f"{_HITS} FROM steps s JOIN cand c ON s.qid = c.qid AND s.i = c.i",
    "tool_protocol": "SELECT * FROM (VALUES (1::BIGINT, '2024-11-05', '', NULL::BIGINT), (2, NULL, 'memory_recall,memory_record', NULL), (3, NULL, '', -32601), (4, NULL, '', -32601), (5, NULL, '', -32000)) t(id, protocol, tools, error)",
    "command_line": f"""WITH RECURSIVE {_CHUNKS}, n AS (SELECT (SELECT count(*) FROM notes) AS files, (SELECT count(*) FROM vchunks) AS c, (SELECT count(DISTINCT path) FROM vchunks) AS f),
  l AS (SELECT count(*) AS recalls, count(DISTINCT coalesce(tenant, '?')) AS tenants FROM query_log WHERE event = 'recall')
SELECT 'index' AS command, 'files_total' AS name, files AS value FROM n UNION ALL SELECT 'index', 'chunks', c FROM n UNION ALL SELECT 'stats', 'files', f FROM n UNION ALL SELECT 'stats', 'chunks', c FROM n
UNION ALL SELECT 'search', 'hits', 3 UNION ALL SELECT 'analyze', 'recalls', recalls FROM l UNION ALL SELECT 'analyze', 'tenants', tenants FROM l""",
    "log_round_trip": """WITH l AS (SELECT round(ts, 3) AS ts, tenant, query, coalesce(len(scores), 0)::INTEGER AS n_results, scores[1] AS top_score, CASE WHEN len(scores) > 0 THEN top_file END AS top_file,
  least(coalesce(len(scores), 0), 5)::INTEGER AS n_scores, CASE WHEN NOT isnan(latency_ms) THEN round(latency_ms, 1) END AS latency_ms, coalesce(len(scores), 0) = 0 AS "empty" FROM query_log WHERE event = 'recall' AND tenant IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY tenant, ts, query ORDER BY latency_ms NULLS FIRST)::INTEGER AS nth FROM l""",
    "log_paths": "SELECT * FROM (VALUES ('off', NULL), ('0', NULL), ('false', NULL), ('/tmp/x.jsonl', '/tmp/x.jsonl'), ('', 'query-log.jsonl')) t(setting, path)",
    "card_files": f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Card Nº ' || doc_id END AS title, CASE WHEN doc_id % 3 > 0 THEN text ELSE doc_id || ' ' || text END AS content, created_at FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL),
  s AS (SELECT *, substr(regexp_replace(regexp_replace(lower(coalesce(title, substr(content, 1, 40))), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug FROM f)
SELECT 'card-' || strftime(created_at, '%Y%m%d-%H%M%S') || '-' || CASE WHEN length(slug) > 0 THEN slug ELSE 'card' END || '.md' AS file, md5({_DECODED.format("coalesce('# ' || title || chr(10) || chr(10), '') || content || chr(10)")}) AS body_md5 FROM s""",
    "tenant_order": "SELECT tenant, n, row_number() OVER (ORDER BY n DESC, tenant)::INTEGER AS place FROM (SELECT coalesce(tenant, '?') AS tenant, count(*) AS n FROM query_log WHERE event = 'recall' GROUP BY 1)",
    "index_names": "SELECT DISTINCT tenant, tenant || '-' || substr(sha256('/vaults/' || tenant), 1, 16) AS name FROM documents WHERE tenant IS NOT NULL",
}
_TEXTS = f"{_HITS}, c.text FROM steps s JOIN cand c ON s.qid = c.qid AND s.i = c.i"
SQL["tool_replies"] = f"""SELECT line_no AS qid, md5(coalesce(t, 'No matching memories found.')) AS text_md5 FROM query_log LEFT JOIN
  (SELECT qid, string_agg('[' || score::VARCHAR || '] ' || file || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS t FROM ({_TEXTS}) GROUP BY qid) h ON h.qid = line_no
WHERE event = 'recall' AND tenant IS NOT NULL AND line_no % 100 = 0 AND query IS NOT NULL"""
