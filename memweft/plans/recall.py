"""Batch recall: vector and keyword channels, fusion, decay, diversity, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..functions.text import snippet, words
from ..operators import fusion, keyword, vectors


def recall(chunks: DataFrame, chunk_vecs: DataFrame, queries: DataFrame, query_vecs: DataFrame, config: RecallConfig, occ: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(tenant, qid, pos, id, score, file, text, snippet): the hits of each query in order of selection.

    ``chunks`` (tenant, cid, path, text, age_days, evergreen) has each cid once; ``chunk_vecs`` is (tenant,
    cid, vec); ``queries`` (tenant, qid, query, k); ``query_vecs`` (tenant, qid, vec). Queries see only their
    own tenant. A query without keyword terms uses the vector channel alone; one of a tenant without
    chunks has no hits. ``score`` is rounded to 5 digits. Ties are broken by cid.
    """
    keys = ["tenant", "qid"]
    vec = vectors.nearest(chunk_vecs.withColumnRenamed("cid", "id"), query_vecs, "tenant", config.vec_pool)
    vec = vec.select("tenant", "qid", F.col("id").alias("cid"), F.col("rank").alias("vec_rank"))
    fts = keyword.bm25_top(chunks.select("tenant", "cid", "text"), queries.select("tenant", "qid", "query"), config.fts_pool, occ, lengths)
    fused = fusion.reciprocal_rank_fusion(vec, fts, config.rrf_k, keys)
    return select_hits(fused, chunks, queries, config)


def select_hits(fused: DataFrame, chunks: DataFrame, queries: DataFrame, config: RecallConfig) -> DataFrame:
    """From fused candidates to hits: decay, ranking, diversity, and the text of the chosen only."""
    keys = ["tenant", "qid"]
    if config.half_life_days > 0:
        fused = fused.join(chunks.select("tenant", "cid", "age_days", "evergreen"), ["tenant", "cid"], "left")
        fused = fused.withColumn("score", F.round(fusion.decayed(F.col("fused"), F.col("age_days"), F.col("evergreen"), config.half_life_days), 12))
    else:
        fused = fused.withColumn("score", F.col("fused"))
    if config.min_score is not None:
        fused = fused.where(F.col("score") >= config.min_score)
    cand = fusion.ranked(fused, keys).join(queries.select(*keys, "k"), keys).where(F.col("i") < F.greatest(4 * F.col("k"), F.lit(12)))
    if config.mmr_lambda < 1.0:
        # tokens only of the few candidates that diversity compares
        toks = chunks.select("tenant", "cid", F.array_distinct(words("text")).alias("toks"))
        lists = cand.join(toks, ["tenant", "cid"], "left").groupBy(*keys).agg(
            F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("i", "cid", "score", F.coalesce("toks", F.array().cast("array<string>")).alias("toks")))).alias("c")
        )
        chosen = lists.withColumn("sel", fusion.mmr(F.transform("c", lambda x: x["toks"]), F.col("k"), config.mmr_lambda))
        picked = chosen.select(*keys, F.posexplode("sel").alias("pos", "at"), "c")
        picked = picked.select(*keys, "pos", F.element_at("c", F.col("at") + 1).alias("x")).select(*keys, "pos", "x.cid", "x.score")
    else:
        picked = cand.where(F.col("i") < F.col("k")).select(*keys, F.col("i").alias("pos"), "cid", "score")
    hits = picked.join(chunks.select("tenant", "cid", "path", "text"), ["tenant", "cid"])
    return hits.select(
        *keys, F.col("pos").cast("int").alias("pos"), F.col("cid").alias("id"), F.round("score", 5).alias("score"), F.col("path").alias("file"), "text", snippet(F.col("text"), config.snippet_chars).alias("snippet")
    )


def rendered(hits: DataFrame) -> DataFrame:
    """(qid, block): the hits of each query as one text, in order: score and file in a line, then the text, a blank line between hits."""
    one = F.concat(F.lit("["), F.format_number("score", 5), F.lit("] "), "file", F.lit("\n"), "text").alias("b")
    block = F.array_sort(F.collect_list(F.struct("pos", one)))
    return hits.groupBy("qid").agg(F.array_join(F.transform(block, lambda x: x["b"]), "\n\n").alias("block"))


def hit_rates(hits: DataFrame, wanted: DataFrame, n_at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row (n, hit1, hit3, ..., mrr): how early the wanted file of each query comes.

    ``wanted`` is (tenant, qid, file); queries without hits count as misses.
    """
    first = hits.join(wanted, ["tenant", "qid", "file"]).groupBy("tenant", "qid").agg((F.min("pos") + 1).alias("r"))
    rows = wanted.select("tenant", "qid").distinct().join(first, ["tenant", "qid"], "left")
    at = [F.avg(F.coalesce((F.col("r") <= n).cast("double"), F.lit(0.0))).alias(f"hit{n}") for n in n_at]
    return rows.agg(F.count(F.lit(1)).alias("n"), *at, F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"))
