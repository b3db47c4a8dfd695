"""Registry of the core queries and their SQL twins.

Queries that search take as queries the recall lines whose ``line_no`` is divisible by 100, each against
all chunks of its tenant.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..functions import text as T
from ..operators import chunking, fusion, incremental, keyword, report, vectors
from ..session import materialize, scratch_dir, table
from ..sources import querylog
from . import recall as R
from .index import index_counts, missing_vectors

CONFIG = RecallConfig(model="signed-hash-64", dim=64)
HALF_LIFE = 30.0


# --- tables --------------------------------------------------------------------------------------
def _chunks(spark, sf) -> DataFrame:
    """Each chunk once. The columns that are needed are picked by Catalyst from the scan."""
    return table(spark, sf, "chunks").where("cid IS NOT NULL AND tenant IS NOT NULL").dropDuplicates(["cid"])


def _queries(spark, sf) -> DataFrame:
    log = table(spark, sf, "query_log").where("event = 'recall' AND tenant IS NOT NULL AND line_no % 100 = 0")
    return log.select("tenant", F.col("line_no").alias("qid"), "query", F.lit(5).alias("k"))


def _vector_ranks(spark, sf, chunks, queries) -> DataFrame:
    vec = lambda c: vectors.embed(F.col(c), CONFIG.model, CONFIG.dim).alias("vec")
    base = chunks.select("tenant", F.col("cid").alias("id"), vec("text"))
    got = vectors.nearest(base, queries.select("tenant", "qid", vec("query")), "tenant", CONFIG.vec_pool)
    return got.select("tenant", "qid", F.col("id").alias("cid"), F.col("rank").alias("vec_rank"))


def _hits(spark, sf, config) -> DataFrame:
    chunks, queries = materialize(_chunks(spark, sf).select("tenant", "cid", "path", "text", "age_days", "evergreen")), _queries(spark, sf)
    vec = lambda c: vectors.embed(F.col(c), config.model, config.dim).alias("vec")
    return R.recall(chunks, chunks.select("tenant", "cid", vec("text")), queries, queries.select("tenant", "qid", vec("query")), config)


# --- text ----------------------------------------------------------------------------------------
def fts_tokens(spark, sf) -> DataFrame:
    t = T.keyword_tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.size(t), F.lit(0)).alias("n_tokens"), F.coalesce(F.size(F.array_distinct(t)), F.lit(0)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def fts_query_terms(spark, sf) -> DataFrame:
    return table(spark, sf, "query_log").select("line_no", F.array_join(T.query_terms("query"), " ").alias("terms"))


def chunk_markdown(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.chunk_markdown(T.without_frontmatter(F.col("text")), 1500)).alias("seq", "chunk"))
    return docs.select("doc_id", "seq", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


def strip_frontmatter(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_frontmatter(F.col("text"))).alias("body_md5"))


def chunk_ids(spark, sf) -> DataFrame:
    c = table(spark, sf, "chunks").select("cid", "path", "text").distinct()
    h = chunking.content_hash(F.col("text"))
    return c.select("cid", h.alias("hash"), chunking.chunk_id(F.col("path"), h).alias("made_cid"))


def chunk_dedup(spark, sf) -> DataFrame:
    """The first chunk of each (path, hash), as delivered; a null hash is taken from the text."""
    c = table(spark, sf, "chunks").select("path", F.coalesce("hash", F.sha2("text", 256)).alias("hash"), "seq", "cid")
    return chunking.first_of_equal(c, "cid")


def provenance_dupes(spark, sf) -> DataFrame:
    c = table(spark, sf, "chunks").select("text", "path").distinct()
    return c.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path")).where("n_paths > 1")


def evergreen_flag(spark, sf) -> DataFrame:
    return table(spark, sf, "files").select("path").distinct().select("path", T.is_evergreen(F.col("path"), CONFIG.evergreen_re).alias("evergreen"))


GLOBS = ("archive/*", "*/_*", "*.conflict-?.md", "*[0-9][!a-z].md")


def ignore_globs(spark, sf) -> DataFrame:
    return table(spark, sf, "files").where(~T.ignored(F.col("path"), GLOBS)).select("tenant", "path").distinct()


def card_slug(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.card_slug(F.lit(None).cast("string"), F.col("text")).alias("slug"))


def snippets(spark, sf) -> DataFrame:
    return table(spark, sf, "chunks").select("cid", T.snippet(F.col("text"), 100).alias("snippet")).distinct()


# --- index ---------------------------------------------------------------------------------------
def _p6(spark, sf):
    files, manifest, runs = (table(spark, sf, t) for t in ("files", "manifest", "runs"))
    return files, manifest, runs, incremental.fix_upper(runs)


def p6_found(spark, sf) -> DataFrame:
    """The durable operator: it takes over the commit log, commits, and then runs over the listing from that mark."""
    files, manifest, runs = (table(spark, sf, t) for t in ("files", "manifest", "runs"))
    run = incremental.IncrementalRun(spark, scratch_dir(spark))
    run.adopt(manifest, runs)
    return run.output(run.step(files)).select("tenant", "path")


def p6_deliveries(spark, sf) -> DataFrame:
    """What each of three runs processes, the first over the first third of the listing's time, and so on; no file is known before."""
    files = table(spark, sf, "files")
    lo, hi = files.agg(F.min("listed_at"), F.max("listed_at")).first()
    run = incremental.IncrementalRun(spark, scratch_dir(spark))
    out = None
    for k in (1, 2, 3):
        until = F.lit(str(lo + (hi - lo) * k // 3)).cast(files.schema["listed_at"].dataType)  # as text: no session's time zone plays a part
        entry = run.step(files.where(F.col("listed_at").isNull() | (F.col("listed_at") <= until)))
        one = run.output(entry).select("tenant", "path", "mtime", F.lit(k).alias("run"))
        out = one if out is None else out.unionByName(one)
    return out


def p6_diff(spark, sf) -> DataFrame:
    return incremental.snapshot_diff(*_p6(spark, sf)).select("tenant", "path", "mtime", "known_mtime", "state")


def snapshot_counters(spark, sf) -> DataFrame:
    d = incremental.snapshot_diff(*_p6(spark, sf))
    return d.groupBy("tenant").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("new", "changed", "unchanged", "deleted")])


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "chunks").select(F.sha2("text", 256).alias("hash"))


def embed_cache_counters(spark, sf) -> DataFrame:
    """For each model, distinct chunk texts whose vector is cached and such as must be embedded."""
    texts, models = _texts(spark, sf), table(spark, sf, "models").select("model")
    total = texts.where("hash IS NOT NULL").agg(F.countDistinct("hash").alias("total"))
    lacking = missing_vectors(texts, table(spark, sf, "emb_cache"), models).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    rows = models.join(lacking, "model", "left").join(total, how="cross")  # one row
    return rows.select("model", (F.col("total") - F.coalesce("n", F.lit(0))).alias("cached"), F.coalesce("n", F.lit(0)).alias("to_embed"))


def embed_misses(spark, sf) -> DataFrame:
    """(hash, model) of every chunk text that lacks a vector of a model."""
    return missing_vectors(_texts(spark, sf), table(spark, sf, "emb_cache"), table(spark, sf, "models"))


def index_stats(spark, sf) -> DataFrame:
    return index_counts(table(spark, sf, "chunks"))


# --- recall --------------------------------------------------------------------------------------
def corpus_stats(spark, sf) -> DataFrame:
    s = keyword.corpus_stats(keyword.doc_lengths(_chunks(spark, sf).select("tenant", "cid", "text")))
    return s.select("tenant", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, sf) -> DataFrame:
    chunks = _chunks(spark, sf).select("tenant", "cid", "text")
    return keyword.bm25(chunks, _queries(spark, sf)).select("qid", "cid", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf) -> DataFrame:
    chunks = _chunks(spark, sf).select("tenant", "cid", "text")
    return keyword.bm25_top(chunks, _queries(spark, sf), CONFIG.fts_pool).select("qid", "cid", "fts_rank")


def knn_l2(spark, sf) -> DataFrame:
    """The 30 nearest of the cached vectors of a model for every vec_id divisible by 100, itself included."""
    e = table(spark, sf, "emb_cache").join(table(spark, sf, "models"), "model")
    fit = e.where((F.size("vec") == F.col("dim")) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))).select("model", "vec_id", "vec").dropDuplicates(["model", "vec_id"])
    got = vectors.nearest(fit.withColumnRenamed("vec_id", "id"), fit.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), "model", 30)
    return got.select("qid", F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


def vector_ranks(spark, sf) -> DataFrame:
    chunks = _chunks(spark, sf)
    return _vector_ranks(spark, sf, chunks, _queries(spark, sf)).select("qid", "cid", F.col("vec_rank").cast("int").alias("vec_rank"))


def _fused(spark, sf) -> DataFrame:
    chunks = materialize(_chunks(spark, sf).select("tenant", "cid", "text"))
    queries = _queries(spark, sf)
    fts = keyword.bm25_top(chunks, queries, CONFIG.fts_pool)
    return fusion.reciprocal_rank_fusion(_vector_ranks(spark, sf, chunks, queries), fts, CONFIG.rrf_k, ["tenant", "qid"])


def rrf_hybrid(spark, sf) -> DataFrame:
    return _fused(spark, sf).select("qid", "cid", F.round("fused", 9).alias("fused"), "vec_rank", "fts_rank")


def temporal_decay(spark, sf) -> DataFrame:
    """Every chunk's factor at a half-life of 30 days."""
    c = _chunks(spark, sf)
    return c.select("cid", F.round(fusion.decayed(F.lit(1.0), F.col("age_days"), F.col("evergreen"), HALF_LIFE), 9).alias("factor"))


def recall_full(spark, sf) -> DataFrame:
    """Flagship: hybrid recall with decay and diversity."""
    h = _hits(spark, sf, replace(CONFIG, half_life_days=HALF_LIFE, snippet_chars=80))
    return h.select("qid", "pos", "id", "score", "file", "snippet")


def recall_plain(spark, sf) -> DataFrame:
    """Hybrid recall without decay or diversity: pure fused order."""
    return _hits(spark, sf, replace(CONFIG, mmr_lambda=1.0)).select("qid", "pos", "id", "score", "file")


def mmr_diversity(spark, sf) -> DataFrame:
    """Diversity over fused candidates without decay."""
    return _hits(spark, sf, CONFIG).select("qid", "pos", "id", "score")


def tenant_isolation(spark, sf) -> DataFrame:
    """Hits of other tenants' chunks: no row may have any."""
    h = _hits(spark, sf, CONFIG).select("tenant", "qid", F.col("id").alias("cid"))
    own = _chunks(spark, sf).select("cid", F.col("tenant").alias("owner"))
    return h.join(own, "cid").groupBy("tenant").agg(F.count_if(F.col("tenant") != F.col("owner")).alias("foreign_hits"))


def render_recall(spark, sf) -> DataFrame:
    """The text block that the tool server answers with, for each query."""
    return R.rendered(_hits(spark, sf, replace(CONFIG, mmr_lambda=1.0))).select("qid", F.md5("block").alias("rendered_md5"))


def hit_at_k_mrr(spark, sf) -> DataFrame:
    """Known-item search: for each query line, how early the file comes that the log names as its top file."""
    log = table(spark, sf, "query_log").where("event = 'recall' AND tenant IS NOT NULL AND line_no % 100 = 0 AND top_file IS NOT NULL")
    wanted = log.select("tenant", F.col("line_no").alias("qid"), F.col("top_file").alias("file"))
    r = R.hit_rates(_hits(spark, sf, replace(CONFIG, mmr_lambda=1.0)), wanted)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "mrr")])


# --- log -----------------------------------------------------------------------------------------
def analyze_overall(spark, sf) -> DataFrame:
    log = table(spark, sf, "query_log").withColumn("latency_ms", F.when(~F.isnan("latency_ms"), F.col("latency_ms")))
    return report.overall(report.recall_lines(log))


def analyze_by_tenant(spark, sf) -> DataFrame:
    return report.by_tenant(report.recall_lines(table(spark, sf, "query_log")))


def recent_misses(spark, sf) -> DataFrame:
    return report.recent_misses(report.recall_lines(table(spark, sf, "query_log")))


def recall_event_json(spark, sf) -> DataFrame:
    """Log lines written as JSON and read back with the fixed schema: nothing is lost but what JSON can't say (a NaN is null)."""
    log = table(spark, sf, "query_log").select("line_no", querylog.as_line().alias("value"))
    back = log.select("line_no", F.from_json("value", querylog.SCHEMA).alias("j"))
    return back.select("line_no", *[f"j.{f.name}" for f in querylog.SCHEMA.fields if f.name != "scores"], F.size("j.scores").alias("n_scores"))


def windowed_recalls(spark, sf) -> DataFrame:
    """The stream's aggregation over the table: recalls by tenant and day."""
    from ..streaming.log_stream import windowed_recalls as windows

    log = table(spark, sf, "query_log").withColumn("latency_ms", F.when(~F.isnan("latency_ms"), F.col("latency_ms")))
    w = windows(log, "1 day", "2 days")
    return w.select("tenant", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("day"), "recalls", F.round("empty_rate", 6).alias("empty_rate"), F.round("mean_latency_ms", 3).alias("mean_latency_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        recall_full, recall_plain, mmr_diversity, rrf_hybrid, bm25_scores, bm25_topk, corpus_stats, knn_l2, vector_ranks, temporal_decay, tenant_isolation, render_recall, hit_at_k_mrr,
        fts_tokens, fts_query_terms, chunk_markdown, strip_frontmatter, chunk_ids, chunk_dedup, provenance_dupes, evergreen_flag, ignore_globs, card_slug, snippets,
        p6_found, p6_diff, p6_deliveries, snapshot_counters, embed_cache_counters, embed_misses, index_stats, analyze_overall, analyze_by_tenant, recent_misses, recall_event_json, windowed_recalls,
    )
}

# --- SQL -----------------------------------------------------------------------------------------
_STATES = """
  ok AS (SELECT run_id FROM runs WHERE lower(status) = 'committed'),
  now AS (SELECT tenant, path, arg_max(mtime, (coalesce(listed_at, TIMESTAMP '0001-01-01'), mtime)) AS mtime FROM files WHERE mtime IS NOT NULL AND tenant IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
  noted AS (SELECT tenant, path, mtime, row_number() OVER (PARTITION BY tenant, path ORDER BY run_id DESC, mtime DESC NULLS LAST) AS r FROM manifest SEMI JOIN ok USING (run_id) WHERE tenant IS NOT NULL AND path IS NOT NULL),
  known AS (SELECT tenant, path, mtime AS known_mtime FROM noted WHERE r = 1),
  diff AS (SELECT tenant, path, mtime, known_mtime, CASE WHEN mtime IS NULL THEN 'deleted' WHEN known_mtime IS NULL THEN 'new' WHEN mtime = known_mtime THEN 'unchanged' ELSE 'changed' END AS state
    FROM now FULL OUTER JOIN known USING (tenant, path) WHERE mtime IS NOT NULL OR known_mtime IS NOT NULL)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(translate(lower(translate({text}, {_q(T.MARKS)}, '')), {_q(T.FOLD_FROM)}, {_q(T.FOLD_TO)}), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_STOP = "[" + ", ".join(map(_q, T.STOPWORDS)) + "]"


def _terms_sql(query: str) -> str:
    w = _WORDS.format(f"coalesce({query}, '')")
    kept = f"list_filter({w}, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {w} END"


_DOCS = """
  docs AS (SELECT DISTINCT ON (cid) tenant, cid, path, text, age_days, evergreen FROM chunks WHERE cid IS NOT NULL AND tenant IS NOT NULL),
  asked AS (SELECT tenant, line_no AS qid, query, top_file FROM query_log WHERE event = 'recall' AND tenant IS NOT NULL AND line_no % 100 = 0)"""

_STATS = f"""
  toks AS MATERIALIZED (SELECT tenant, cid, {tokens_sql("text")} AS t FROM docs),
  lens AS (SELECT tenant, cid, coalesce(len(t), 0) AS dl FROM toks),
  stats AS (SELECT tenant, count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM lens GROUP BY tenant)"""

_BASE = f"{_DOCS}, {_STATS}"

_FTS = f"""
  terms AS (SELECT tenant, qid, unnest({_terms_sql("query")}) AS term FROM asked),
  phrases AS (SELECT tenant, qid, array_to_string(p, ' ') AS phrase, count(*) AS times FROM (SELECT tenant, qid, {tokens_sql("term")} AS p FROM terms) WHERE len(p) > 0 GROUP BY ALL),
  occ AS MATERIALIZED (SELECT tenant, cid, term, pos FROM (SELECT tenant, cid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks)),
  wanted AS (SELECT DISTINCT tenant, phrase, string_split(phrase, ' ') AS p FROM phrases),
  wtok AS (SELECT tenant, phrase, len(p) AS m, unnest(p) AS term, unnest(range(len(p))) AS i FROM wanted),
  starts AS (SELECT w.tenant, w.phrase, o.cid FROM wtok w JOIN occ o ON o.tenant = w.tenant AND o.term = w.term GROUP BY w.tenant, w.phrase, w.m, o.cid, o.pos - w.i HAVING count(*) = w.m),
  tf AS (SELECT tenant, phrase, cid, count(*) AS f FROM starts GROUP BY ALL),
  df AS (SELECT tenant, phrase, count(*) AS n FROM tf GROUP BY ALL),
  weights AS (SELECT tf.tenant, tf.phrase, tf.cid, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w
    FROM tf JOIN df USING (tenant, phrase) JOIN stats USING (tenant) JOIN lens USING (tenant, cid)),
  bm AS (SELECT tenant, qid, cid, sum(w * times) AS score FROM phrases JOIN weights USING (tenant, phrase) GROUP BY ALL),
  fts AS (SELECT * FROM (SELECT tenant, qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) - 1 AS fts_rank FROM bm) WHERE fts_rank < 30)"""


def _vector_sql(rows: str, key: str, text: str) -> str:
    """Normalised signed word counts in 64 slots of float, as arrays."""
    return f"""(SELECT tenant, {key}, list_transform(v, lambda x: (x / CASE WHEN n > 0 THEN sqrt(n) ELSE 1 END)::FLOAT) AS vec FROM (
    SELECT tenant, {key}, v, list_sum(list_transform(v, lambda x: x * x))::DOUBLE AS n FROM (
      SELECT r.tenant, r.{key}, list_transform(range(64), lambda s: coalesce(element_at(m, s)[1], 0)) AS v FROM {rows} r LEFT JOIN (
        SELECT {key}, map_from_entries(list((slot, c))) AS m FROM (
          SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS c
          FROM (SELECT {key}, md5(unnest({_WORDS.format(text)})) AS h FROM {rows}) GROUP BY ALL) GROUP BY {key}) USING ({key}))))"""


_VEC = f"""
  dvec AS MATERIALIZED {_vector_sql("docs", "cid", "text")},
  qvec AS MATERIALIZED {_vector_sql("asked", "qid", "query")},
  dist AS (SELECT q.tenant, q.qid, d.cid, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.vec[i]::DOUBLE - d.vec[i]::DOUBLE) * (q.vec[i]::DOUBLE - d.vec[i]::DOUBLE)))) AS d FROM qvec q JOIN dvec d ON q.tenant = d.tenant),
  vec AS (SELECT * FROM (SELECT tenant, qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round(d, 12), cid) - 1 AS vec_rank FROM dist) WHERE vec_rank < 30)"""


def fused_sql(docs: str) -> str:
    """From the CTEs docs and asked to fused."""
    return f"""{docs}, {_STATS}, {_FTS}, {_VEC},
  fused AS (SELECT coalesce(v.tenant, f.tenant) AS tenant, coalesce(v.qid, f.qid) AS qid, coalesce(v.cid, f.cid) AS cid, vec_rank, fts_rank,
    coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0) AS fused FROM vec v FULL OUTER JOIN fts f ON v.qid = f.qid AND v.cid = f.cid)"""


_FUSED = fused_sql(_DOCS)


def ranked_sql(half_life: float) -> str:
    score = "fused" if half_life <= 0 else f"round(CASE WHEN coalesce(evergreen, false) OR age_days IS NULL THEN fused ELSE fused * exp({-math.log(2.0) / half_life!r}::DOUBLE * age_days) END, 12)"
    return f"""
  scored AS (SELECT f.*, d.path, d.text, {score} AS score FROM fused f JOIN docs d USING (cid)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_rank ASC NULLS LAST, fts_rank ASC NULLS LAST, cid) - 1 AS i, count(*) OVER (PARTITION BY qid) AS n_all FROM scored)"""


def mmr_sql(half_life: float, fused: str = _FUSED) -> str:
    return f"""WITH RECURSIVE {fused}, {ranked_sql(half_life)},
  cand AS MATERIALIZED (SELECT qid, i, cid, path, text, score, least(n_all, 20) AS n, n_all, list_distinct({_WORDS.format("text")}) AS t FROM ranked WHERE i < 20),
  jac AS MATERIALIZED (SELECT a.qid, a.i, b.i AS j, len(list_intersect(a.t, b.t)) / greatest(1, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS s FROM cand a JOIN cand b ON a.qid = b.qid AND a.i <> b.i),
  steps(qid, pos, i, sel) AS (
    SELECT qid, 0, i, [i] FROM cand WHERE i = 0
    UNION ALL
    SELECT qid, pos + 1, nxt, list_append(sel, nxt) FROM (
      SELECT s.qid, s.pos, s.sel, (SELECT arg_min(c.i, (-(CASE WHEN c.n_all <= 5 THEN -c.i::DOUBLE ELSE 0.7::DOUBLE * (1.0::DOUBLE - c.i / c.n::DOUBLE) - (1 - 0.7::DOUBLE) * (SELECT max(j.s) FROM jac j WHERE j.qid = c.qid AND j.i = c.i AND list_contains(s.sel, j.j)) END), c.i)) FROM cand c WHERE c.qid = s.qid AND NOT list_contains(s.sel, c.i)) AS nxt
      FROM steps s WHERE s.pos < 4) WHERE nxt IS NOT NULL)"""


PARAS = "list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g')), lambda p: length(p) > 0)"
BODY = "regexp_replace(text, '(?s)\\A---\\r?\\n.*?\\r?\\n---\\r?\\n', '')"

SQL = {
    "recall_full": f"{mmr_sql(HALF_LIFE)} SELECT s.qid, s.pos::INTEGER AS pos, c.cid AS id, round(c.score, 5) AS score, c.path AS file, substr(c.text, 1, 80) AS snippet FROM steps s JOIN cand c ON s.qid = c.qid AND s.i = c.i",
    "mmr_diversity": f"{mmr_sql(0)} SELECT s.qid, s.pos::INTEGER AS pos, c.cid AS id, round(c.score, 5) AS score FROM steps s JOIN cand c ON s.qid = c.qid AND s.i = c.i",
    "recall_plain": f"WITH {_FUSED}, {ranked_sql(0)} SELECT qid, i::INTEGER AS pos, cid AS id, round(score, 5) AS score, path AS file FROM ranked WHERE i < 5",
    "rrf_hybrid": f"WITH {_FUSED} SELECT qid, cid, round(fused, 9) AS fused, vec_rank::INTEGER AS vec_rank, fts_rank::INTEGER AS fts_rank FROM fused",
    "bm25_scores": f"WITH {_BASE}, {_FTS} SELECT qid, cid, round(score, 6) AS score FROM bm",
    "bm25_topk": f"WITH {_BASE}, {_FTS} SELECT qid, cid, fts_rank::INTEGER AS fts_rank FROM fts",
    "corpus_stats": f"WITH {_BASE} SELECT tenant, n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "knn_l2": """WITH ok AS (SELECT DISTINCT ON (e.model, e.vec_id) e.vec_id, e.model, e.vec FROM emb_cache e JOIN models m ON e.model = m.model AND len(e.vec) = m.dim WHERE len(list_filter(e.vec, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  r AS (SELECT a.vec_id AS qid, b.vec_id, list_distance(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec::DOUBLE[], b.vec::DOUBLE[]), b.vec_id) - 1 AS rank FROM ok a JOIN ok b ON a.model = b.model WHERE a.vec_id % 100 = 0)
SELECT qid, vec_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM r WHERE rank < 30""",
    "vector_ranks": f"WITH {_BASE}, {_VEC} SELECT qid, cid, vec_rank::INTEGER AS vec_rank FROM vec",
    "temporal_decay": f"WITH {_BASE} SELECT cid, round(CASE WHEN coalesce(evergreen, false) OR age_days IS NULL THEN 1.0::DOUBLE ELSE exp({-math.log(2.0) / HALF_LIFE!r}::DOUBLE * age_days) END, 9) AS factor FROM docs",
    "tenant_isolation": "WITH c AS (SELECT DISTINCT tenant FROM chunks) SELECT DISTINCT q.tenant, 0::BIGINT AS foreign_hits FROM query_log q JOIN c ON q.tenant = c.tenant WHERE event = 'recall' AND line_no % 100 = 0",
    "render_recall": f"WITH {_FUSED}, {ranked_sql(0)} SELECT qid, md5(string_agg('[' || printf('%.5f', round(score, 5)) || '] ' || path || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS rendered_md5 FROM ranked WHERE i < 5 GROUP BY qid",
    "hit_at_k_mrr": f"""WITH {_FUSED}, {ranked_sql(0)}, w AS (SELECT qid, top_file FROM asked WHERE top_file IS NOT NULL),
  f AS (SELECT w.qid, min(i) + 1 AS r FROM w LEFT JOIN ranked ON ranked.qid = w.qid AND ranked.path = w.top_file AND i < 5 GROUP BY w.qid)
SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f""",
    "fts_tokens": f"SELECT doc_id, coalesce(len(t), 0)::INTEGER AS n_tokens, coalesce(len(list_distinct(t)), 0)::INTEGER AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "fts_query_terms": f"SELECT line_no, array_to_string({_terms_sql('query')}, ' ') AS terms FROM query_log",
    "chunk_markdown": f"""WITH RECURSIVE src AS (SELECT doc_id, {BODY} AS body FROM documents WHERE text IS NOT NULL), paras AS (SELECT doc_id, {PARAS} AS p FROM src),
  fold(doc_id, p, i, cur, seq, done) AS (
    SELECT doc_id, p, 1, '', 0, NULL::VARCHAR FROM paras WHERE len(p) > 0
    UNION ALL
    SELECT doc_id, p, i + 1,
      CASE WHEN i > len(p) THEN '' WHEN length(cur) + length(p[i]) < 1500 THEN CASE WHEN cur = '' THEN p[i] ELSE cur || chr(10) || chr(10) || p[i] END ELSE p[i] END,
      CASE WHEN done IS NULL THEN seq ELSE seq + 1 END,
      CASE WHEN i > len(p) OR length(cur) + length(p[i]) >= 1500 THEN nullif(cur, '') END
    FROM fold WHERE i <= len(p) + 1)
SELECT doc_id, seq::INTEGER AS seq, length(done)::INTEGER AS n, md5(done) AS chunk_md5 FROM fold WHERE done IS NOT NULL""",
    "strip_frontmatter": f"SELECT doc_id, md5({BODY}) AS body_md5 FROM documents",
    "chunk_ids": "SELECT cid, sha256(text) AS hash, sha256(path || chr(0) || sha256(text)) AS made_cid FROM (SELECT DISTINCT cid, path, text FROM chunks)",
    "chunk_dedup": "SELECT path, coalesce(hash, sha256(text)) AS hash, min(seq) AS seq, arg_min(cid, (seq, cid)) AS cid, count(*) AS n_rows FROM chunks GROUP BY 1, 2",
    "provenance_dupes": "SELECT sha256(text) AS hash, count(*) AS n_paths, min(path) AS first_path FROM (SELECT DISTINCT text, path FROM chunks) GROUP BY text HAVING count(*) > 1",
    "evergreen_flag": "SELECT DISTINCT path, regexp_matches(string_split(path, '/')[-1], '(?i)^(?:^(MEMORY|INDEX|.*reference_|.*architecture).*)') AS evergreen FROM files",
    "ignore_globs": "SELECT DISTINCT tenant, path FROM files WHERE NOT (path GLOB 'archive/*' OR path GLOB '*/_*' OR path GLOB '*.conflict-?.md' OR regexp_full_match(path, '(?s).*[0-9][^a-z]\\.md'))",
    "card_slug": "SELECT doc_id, CASE WHEN length(s) > 0 THEN s ELSE 'card' END AS slug FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^\\p{L}\\p{N}]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS s FROM documents)",
    "snippets": "SELECT DISTINCT cid, substr(text, 1, 100) AS snippet FROM chunks",
    "p6_found": f"WITH {_STATES} SELECT tenant, path FROM diff WHERE state IN ('new', 'changed')",
    "p6_diff": f"WITH {_STATES} SELECT tenant, path, mtime, known_mtime, state FROM diff",
    "p6_deliveries": """WITH lim AS (SELECT min(listed_at) AS lo, epoch_us(max(listed_at)) - epoch_us(min(listed_at)) AS span FROM files),
  k AS (SELECT unnest([1, 2, 3]) AS run),
  st AS (SELECT run, tenant, path, arg_max(mtime, (coalesce(listed_at, TIMESTAMP '0001-01-01'), mtime)) AS mtime FROM files, lim, k
    WHERE mtime IS NOT NULL AND tenant IS NOT NULL AND path IS NOT NULL AND (listed_at IS NULL OR listed_at <= lo + to_microseconds(span * run // 3)) GROUP BY ALL),
  was AS (SELECT *, lag(mtime) OVER (PARTITION BY tenant, path ORDER BY run) AS old FROM st)
SELECT tenant, path, mtime, run FROM was WHERE old IS NULL OR old <> mtime""",
    "snapshot_counters": f"WITH {_STATES} SELECT tenant, count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'changed') AS n_changed, count(*) FILTER (state = 'unchanged') AS n_unchanged, count(*) FILTER (state = 'deleted') AS n_deleted FROM diff GROUP BY tenant",
    "embed_cache_counters": """WITH t AS (SELECT DISTINCT sha256(text) AS hash FROM chunks WHERE text IS NOT NULL), e AS (SELECT DISTINCT hash, model FROM emb_cache WHERE hash IS NOT NULL AND vec IS NOT NULL)
SELECT m.model, count(t.hash) AS cached, (SELECT count(*) FROM t) - count(t.hash) AS to_embed FROM models m LEFT JOIN e ON e.model = m.model LEFT JOIN t ON t.hash = e.hash GROUP BY m.model""",
    "embed_misses": """SELECT DISTINCT sha256(text) AS hash, m.model FROM chunks, models m WHERE text IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM emb_cache e WHERE e.hash = sha256(text) AND e.model = m.model AND vec IS NOT NULL)""",
    "index_stats": "SELECT tenant, count(DISTINCT cid) AS chunks, count(DISTINCT path) AS files FROM chunks GROUP BY tenant",
    "analyze_overall": """WITH l AS (SELECT "empty" AS e, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS lat, top_score FROM query_log WHERE event = 'recall'), s AS (SELECT list_sort(list(lat) FILTER (lat IS NOT NULL)) AS v FROM l)
SELECT count(*) AS recalls, round(count(*) FILTER (e) / count(*), 3) AS empty_rate, round(median(lat), 1) AS latency_p50_ms, round((SELECT v[floor(len(v) * 0.95)::BIGINT + 1] FROM s WHERE len(v) > 2), 1) AS latency_p95_ms, round(avg(top_score), 5) AS avg_top_score FROM l""",
    "analyze_by_tenant": "SELECT coalesce(tenant, '?') AS tenant, count(*) AS n FROM query_log WHERE event = 'recall' GROUP BY 1",
    "recent_misses": "SELECT line_no, substr(query, 1, 70) AS query FROM query_log WHERE event = 'recall' AND \"empty\" ORDER BY line_no DESC LIMIT 8",
    "windowed_recalls": """SELECT coalesce(tenant, '?') AS tenant, strftime(make_timestamp(floor(ts / 86400)::BIGINT * 86400000000), '%Y-%m-%d') AS day, count(*) AS recalls, round(avg(CASE WHEN coalesce("empty", false) THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round(avg(CASE WHEN NOT isnan(latency_ms) THEN latency_ms END), 3) AS mean_latency_ms
FROM query_log WHERE event = 'recall' AND ts IS NOT NULL GROUP BY 1, 2""",
    "recall_event_json": "SELECT line_no, ts, event, tenant, query, n_results, top_score, top_file, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS latency_ms, \"empty\", coalesce(len(scores), -1)::INTEGER AS n_scores FROM query_log",
}
