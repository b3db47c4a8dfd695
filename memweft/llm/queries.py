"""Queries pN_ of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_dir, table
from . import canonical, knngraph, language, markup, mixing, neardup, packing, quantiles, spans


# --- p1: near-duplicates -------------------------------------------------------------------------
def p1_found(spark, sf) -> DataFrame:
    return neardup.found(table(spark, sf, "chunks"))


def p1_groups(spark, sf) -> DataFrame:
    return neardup.groups(table(spark, sf, "chunks"))


def p1_links(spark, sf) -> DataFrame:
    return neardup.representatives(table(spark, sf, "chunks"))


def p1_recall(spark, sf) -> DataFrame:
    return neardup.recall(table(spark, sf, "chunks"))


# --- p2: markup residue --------------------------------------------------------------------------
def p2_found(spark, sf) -> DataFrame:
    return markup.found(table(spark, sf, "chunks"))


def p2_clean(spark, sf) -> DataFrame:
    return markup.convert(table(spark, sf, "chunks"))


# --- p3: most similar vectors --------------------------------------------------------------------
def p3_found(spark, sf) -> DataFrame:
    return knngraph.found(table(spark, sf, "emb_cache"), table(spark, sf, "models"))


def p3_recall(spark, sf) -> DataFrame:
    return knngraph.recall(table(spark, sf, "emb_cache"), table(spark, sf, "models"))


# --- p4: languages -------------------------------------------------------------------------------
def p4_found(spark, sf) -> DataFrame:
    return language.found(table(spark, sf, "chunks"))


def p4_segments(spark, sf) -> DataFrame:
    return language.chunk_segments(table(spark, sf, "chunks"))


def p4_languages(spark, sf) -> DataFrame:
    """The languages of every chunk that has a whole sentence, each with its confidence."""
    segs = language.chunk_segments(table(spark, sf, "chunks"))
    return language.document_languages(segs).select("cid", "lang", "confidence", "sentences", "n_langs")


# --- p5: duplicates hidden by formatting ---------------------------------------------------------
def _ledger(spark, sf) -> canonical.Ledger:
    """The chunks in two deliveries, by tenant, added to a ledger one after the other, the second delivered twice."""
    chunks = table(spark, sf, "chunks")
    half = F.pmod(F.crc32(F.coalesce("tenant", F.lit(""))), F.lit(2))
    root = scratch_dir(spark)
    canonical.Ledger(spark, root).update(canonical.keyed(chunks.where(half == 0)), "first")
    ledger = canonical.Ledger(spark, root)  # as the next process would open it
    for _ in range(2):
        ledger.update(canonical.keyed(chunks.where(half == 1)), "second")
    return ledger


def p5_found(spark, sf) -> DataFrame:
    ledger = _ledger(spark, sf)
    many = ledger.table().where("copies > 1").select("key", F.col("first_cid").alias("cid_first"))
    copies = ledger.members().withColumnRenamed("cid", "cid_copy")
    return copies.join(many, "key").where("cid_copy <> cid_first").select("cid_first", "cid_copy")


def p5_ledger(spark, sf) -> DataFrame:
    return _ledger(spark, sf).table().select("first_cid", "first_hash", "copies", "n_rows")


# --- p7: percentiles -----------------------------------------------------------------------------
FIELDS = ["latency_ms", "top_score"]


def _daily(spark, sf) -> DataFrame:
    return quantiles.sketch(quantiles.recall_values(table(spark, sf, "query_log")), ["tenant", "day"], FIELDS, salt="salt")


def p7_found(spark, sf) -> DataFrame:
    whole = quantiles.merge_sketches(_daily(spark, sf), ["tenant", "field"])
    got = quantiles.percentiles(whole, {"p50": 0.5, "p95": 0.95})
    slow = (F.col("field") == "latency_ms") & (F.col("p95") > 400)
    weak = (F.col("field") == "top_score") & (F.col("p50") < 0.02)
    return got.where(slow | weak).select("tenant", "field")


def p7_percentiles(spark, sf) -> DataFrame:
    whole = quantiles.merge_sketches(_daily(spark, sf), ["tenant", "field"])
    return quantiles.percentiles(whole, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p7_ranks(spark, sf) -> DataFrame:
    """For each tenant, field and percentile, whether it is within its error of the exact rank."""
    qs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    values = materialize(quantiles.recall_values(table(spark, sf, "query_log")))
    whole = quantiles.merge_sketches(quantiles.sketch(values, ["tenant", "day"], FIELDS, salt="salt"), ["tenant", "field"])
    return quantiles.exact_ranks(values, quantiles.percentiles(whole, qs), ["tenant"], FIELDS, qs)


def p7_daily(spark, sf) -> DataFrame:
    return quantiles.percentiles(_daily(spark, sf), {"p50": 0.5, "p95": 0.95})


# --- p8: packing ---------------------------------------------------------------------------------
def p8_pack(spark, sf) -> DataFrame:
    return packing.pack_all(table(spark, sf, "documents"), table(spark, sf, "pack_limits"))


def p8_usage(spark, sf) -> DataFrame:
    return packing.usage(p8_pack(spark, sf), table(spark, sf, "pack_limits"))


def p8_invariants(spark, sf) -> DataFrame:
    """For each container: how many documents are placed, and whether all fit, are whole where they can be, and lose no token."""
    return packing.invariants(table(spark, sf, "documents"), table(spark, sf, "pack_limits"))


# --- p9: mixing ----------------------------------------------------------------------------------
def p9_mix(spark, sf) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark, sf) -> DataFrame:
    return mixing.shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_invariants(spark, sf) -> DataFrame:
    """For each source: its different texts, and whether its cap holds and its share is within a percentage point of its target."""
    caps = table(spark, sf, "mix_targets").select("source", "max_repeats", "weight")
    rows = mixing.shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).join(caps, "source")
    near = F.abs(F.col("actual_share") - F.col("target_share")) < 0.01
    return rows.select("source", "texts", (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats")).alias("capped"), F.when(F.col("texts") >= 1000, near).otherwise(F.lit(True)).alias("near"))


# --- p10: long shared spans ----------------------------------------------------------------------
def p10_found(spark, sf) -> DataFrame:
    return spans.found(table(spark, sf, "documents"))


def p10_members(spark, sf) -> DataFrame:
    return spans.members(table(spark, sf, "documents"))


def p10_shared(spark, sf) -> DataFrame:
    return spans.shared_share(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p1_links, p1_recall, p2_found, p2_clean, p3_found, p3_recall, p4_found, p4_segments, p4_languages, p5_found, p5_ledger, p7_found, p7_percentiles, p7_ranks, p7_daily, p8_pack, p8_usage, p8_invariants, p9_mix, p9_shares, p9_invariants, p10_found, p10_shared, p10_members)
}

_KEYED = r"""
  parts AS (SELECT cid, hash, text, list_filter(regexp_split_to_array(text, '[\r\n;]+'), lambda p: regexp_matches(p, '[^\s\x{FEFF}\x{00A0}]')) AS parts FROM chunks WHERE cid IS NOT NULL AND text IS NOT NULL),
  keyed AS (SELECT cid, hash, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[\s\x{FEFF}]*[\p{L}\p{N}_\-]+\s*[:=](?s:.*)[\p{L}\p{N}]'))) = 0
    THEN array_to_string(list_sort(list_transform(parts, lambda p: regexp_replace(lower(p), '[^\p{L}\p{N}]+', '', 'g'))), chr(1))
    ELSE regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') END AS key FROM parts)"""

_RECALLS = """
  lines AS (SELECT DISTINCT ts, event, tenant, query, n_results, top_score, top_file, scores, latency_ms, "empty" FROM query_log WHERE event = 'recall' AND tenant IS NOT NULL)"""

_SPANS = """
  texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160),
  wins AS (SELECT doc_id, p, substr(text, p, 160) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS p FROM texts)),
  many AS (SELECT w FROM wins GROUP BY w HAVING count(DISTINCT doc_id) > 1),
  hits AS (SELECT doc_id, p, w FROM wins SEMI JOIN many USING (w))"""

SQL = {
    "p1_found": f"""WITH {_KEYED},
  docs AS (SELECT DISTINCT c.cid, k.key, regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM chunks c JOIN keyed k USING (cid)),
  grams AS (SELECT DISTINCT cid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT cid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
  sizes AS (SELECT cid, count(*) AS n FROM grams GROUP BY cid),
  common AS (SELECT a.cid AS x, b.cid AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.cid < b.cid GROUP BY 1, 2)
SELECT x AS cid_a, y AS cid_b FROM common JOIN sizes s ON s.cid = x JOIN sizes t ON t.cid = y
JOIN (SELECT DISTINCT cid, key FROM keyed) k ON k.cid = x JOIN (SELECT DISTINCT cid, key FROM keyed) l ON l.cid = y
WHERE k.key <> l.key AND c >= 0.6 * (s.n + t.n - c)""",
    "p1_groups": f"""WITH RECURSIVE {_KEYED},
  docs AS (SELECT DISTINCT c.cid, k.key, regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM chunks c JOIN keyed k USING (cid)),
  grams AS (SELECT DISTINCT cid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT cid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
  sets AS (SELECT d.cid, d.key, list_sort(list(g) FILTER (g IS NOT NULL)) AS s FROM docs d LEFT JOIN grams USING (cid) GROUP BY ALL),
  cls AS (SELECT cid, key, min(cid) OVER (PARTITION BY key, s) AS rep FROM sets),
  reps AS (SELECT DISTINCT rep, key FROM cls),
  rg AS (SELECT cid AS rep, g FROM grams JOIN reps ON rep = cid),
  sizes AS (SELECT rep, count(*) AS n FROM rg GROUP BY rep),
  common AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM rg a JOIN rg b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
  link AS (SELECT x, y FROM common JOIN sizes s ON s.rep = x JOIN sizes t ON t.rep = y JOIN reps k ON k.rep = x JOIN reps l ON l.rep = y WHERE k.key <> l.key AND c >= 0.6 * (s.n + t.n - c)),
  edge AS (SELECT x, y FROM link UNION SELECT a.rep, b.rep FROM reps a JOIN reps b USING (key) WHERE a.rep <> b.rep),
  reach(n, m) AS (SELECT rep, rep FROM reps UNION SELECT n, y FROM reach JOIN edge ON m = x),
  comp AS (SELECT n AS rep, min(m) AS group_cid, count(*) AS group_classes FROM reach GROUP BY n),
  deg AS (SELECT x AS rep, count(*) AS links FROM link GROUP BY x)
SELECT DISTINCT cls.cid, ch.path, cls.rep AS class_cid, group_cid, group_classes, coalesce(links, 0) AS links
FROM cls JOIN comp USING (rep) LEFT JOIN deg USING (rep) JOIN chunks ch ON ch.cid = cls.cid""",
    "p3_found": """WITH ok AS (SELECT DISTINCT e.vec_id, e.model, e.vec FROM emb_cache e JOIN models m ON e.model = m.model AND len(e.vec) = m.dim
    WHERE len(list_filter(e.vec, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(e.vec, lambda v: v <> 0)) > 0),
  ranked AS (SELECT a.vec_id, b.vec_id AS near_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec::DOUBLE[], b.vec::DOUBLE[]), b.vec_id) AS r FROM ok a JOIN ok b ON a.model = b.model AND a.vec_id <> b.vec_id)
SELECT vec_id, near_id FROM ranked WHERE r <= 5""",
    "p5_found": f"""WITH {_KEYED}, firsts AS (SELECT key, min(cid) AS cid_first FROM keyed GROUP BY key)
SELECT DISTINCT cid_first, cid AS cid_copy FROM keyed JOIN firsts USING (key) WHERE cid <> cid_first""",
    "p5_ledger": f"""WITH {_KEYED}
SELECT min(cid) AS first_cid, arg_min(hash, cid) AS first_hash, count(DISTINCT cid) AS copies, count(*) AS n_rows FROM
  (SELECT key, cid, max(hash) OVER (PARTITION BY key, cid) AS hash FROM keyed) GROUP BY key""",
    "p7_found": f"""WITH {_RECALLS}
SELECT tenant, 'latency_ms' AS field FROM lines WHERE isfinite(latency_ms) AND latency_ms >= 0 GROUP BY tenant HAVING quantile_cont(latency_ms, 0.95) > 400
UNION ALL SELECT tenant, 'top_score' AS field FROM lines WHERE top_score IS NOT NULL AND NOT isnan(top_score) GROUP BY tenant HAVING median(top_score) < 0.02""",
    "p7_ranks": f"""WITH {_RECALLS},
  v AS (SELECT tenant, 'latency_ms' AS field FROM lines WHERE isfinite(latency_ms) AND latency_ms >= 0 UNION ALL SELECT tenant, 'top_score' FROM lines WHERE top_score IS NOT NULL AND NOT isnan(top_score))
SELECT tenant, field, p AS percentile, count(*) AS n, true AS within FROM v, (SELECT unnest(['p50', 'p90', 'p95', 'p99']) AS p) GROUP BY ALL""",
    "p8_invariants": """SELECT container, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS docs, true AS fits, true AS whole, true AS complete FROM pack_limits WHERE capacity_tokens > 0""",
    "p9_invariants": """WITH r AS (SELECT text, arg_min(lower(trim(d.source)), doc_id) AS source FROM documents d JOIN mix_targets m ON m.source = lower(trim(d.source)) WHERE doc_id IS NOT NULL AND length(text) > 0 GROUP BY text)
SELECT source, count(*) AS texts, true AS capped, true AS near FROM r GROUP BY source""",
    "p10_found": f"""WITH {_SPANS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.w = b.w AND a.doc_id < b.doc_id""",
    "p10_members": """WITH d AS (SELECT DISTINCT doc_id, md5(text) AS text_key FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160)
SELECT doc_id, text_key, min(doc_id) OVER (PARTITION BY text_key) AS first_id, count(*) OVER (PARTITION BY text_key) AS copies FROM d""",
    "p10_shared": f"""WITH {_SPANS},
  steps AS (SELECT doc_id, least(160, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 160)) AS c FROM hits),
  cover AS (SELECT doc_id, sum(c) AS c FROM steps GROUP BY doc_id),
  alldocs AS (SELECT DISTINCT doc_id, coalesce(length(text), 0) AS n_chars FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, n_chars::BIGINT AS n_chars, coalesce(c, 0)::BIGINT AS shared_chars, round(CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars ELSE 0 END, 6)::DOUBLE AS share FROM alldocs LEFT JOIN cover USING (doc_id)""",
}
