"""Keyword channel: positional postings and BM25 over them, tenants apart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens, query_terms
from ..session import materialize

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Slots of the filter through which a scan's tokens pass; this bounds what a batch of queries sends along.
SLOTS = 1 << 16


def occurrences(chunks: DataFrame, *more: str) -> DataFrame:
    """(tenant, cid, more..., pos, term): every token occurrence of each different chunk."""
    return chunks.select("tenant", "cid", *more, F.posexplode(keyword_tokens("text")).alias("pos", "term"))


def doc_lengths(chunks: DataFrame) -> DataFrame:
    """(tenant, cid, dl): tokens of each chunk, 0 for an empty or null text."""
    return chunks.select("tenant", "cid", F.coalesce(F.size(keyword_tokens("text")), F.lit(0)).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(tenant, n_docs, avgdl) of each tenant's chunks."""
    return lengths.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(tenant, qid, ti, m, i, term): the tokens of each query term.

    A term with ``_`` is a phrase of m > 1 tokens, found where they follow each other; a term without
    tokens (``_``) finds nothing.
    """
    terms = queries.select("tenant", "qid", F.posexplode(query_terms("query")).alias("ti", "t"))
    parts = terms.withColumn("p", keyword_tokens("t")).where(F.size("p") > 0)
    return parts.select("tenant", "qid", "ti", F.size("p").alias("m"), F.posexplode("p").alias("i", "term"))


def term_frequencies(occ: DataFrame, phrases: DataFrame) -> DataFrame:
    """(tenant, phrase, m, cid, tf): how often each different query phrase occurs in each chunk of its tenant."""
    distinct = phrases.groupBy("tenant", "qid", "ti").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("p"))
    phrase = F.array_join(F.transform("p", lambda x: x["term"]), " ")
    distinct = distinct.select("tenant", phrase.alias("phrase"), "p").distinct()
    tokens = distinct.select("tenant", "phrase", F.size("p").alias("m"), F.explode("p").alias("x")).select("tenant", "phrase", "m", "x.i", "x.term")
    # one equi-join finds single terms and phrases alike: a phrase starts where all its tokens agree
    hits = occ.join(tokens, ["tenant", "term"]).select("tenant", "phrase", "m", "cid", (F.col("pos") - F.col("i")).alias("at"))
    single = hits.where("m = 1").groupBy("tenant", "phrase", "m", "cid").agg(F.count(F.lit(1)).alias("tf"))
    whole = hits.where("m > 1").groupBy("tenant", "phrase", "m", "cid", "at").agg(F.count(F.lit(1)).alias("k")).where("k = m")
    return single.union(whole.groupBy("tenant", "phrase", "m", "cid").agg(F.count(F.lit(1)).alias("tf")))


def scanned(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(tenant, cid, dl, hits): each chunk's length and those of its tokens that the phrases may ask for, written to scratch.

    A text is cut into tokens once. Tokens pass a table of ``SLOTS`` hash slots that the phrases fill, so what is
    exploded and joined later is in proportion to what is asked, not to the corpus; a slot that two terms share
    only lets a token through that the join then drops.
    """
    slot = lambda tenant, term: F.pmod(F.xxhash64(tenant, term), F.lit(SLOTS)).cast("int")
    table = bytearray(SLOTS)
    for r in phrases.select(slot(F.col("tenant"), F.col("term")).alias("s")).distinct().collect():  # at most SLOTS rows
        table[r["s"]] = 1
    asked = lambda e: F.substring(F.lit(bytes(table)), slot(F.col("tenant"), e["term"]) + 1, F.lit(1)) == F.lit(b"\x01")
    placed = lambda t: F.transform(t, lambda x, i: F.struct(i.alias("pos"), x.alias("term")))
    # one lambda over the array of tokens, or the text would be cut for each of the two uses
    both = F.transform(F.array(keyword_tokens("text")), lambda t: F.struct(F.greatest(F.size(t), F.lit(0)).alias("dl"), F.filter(placed(t), asked).alias("hits")))[0]
    return materialize(chunks.select("tenant", "cid", both.alias("b")).select("tenant", "cid", "b.dl", "b.hits"))


def bm25(chunks: DataFrame, queries: DataFrame, occ: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(tenant, qid, cid, score) of all chunks of the query's tenant with any of its terms, higher is better.

    ``chunks`` (tenant, cid, text) has each cid once; ``queries`` is (tenant, qid, query). A term
    that occurs twice in a query counts twice. Frequencies are of the tenant alone, so one tenant's
    text never shows in another's ranking. ``occ`` and ``lengths`` (tenant, cid, dl) are stored occurrences and
    lengths of the chunks, if there are any.
    """
    phrases = materialize(query_phrases(queries))
    if occ is None:
        scan = scanned(chunks, phrases)
        occ, lengths = scan.select("tenant", "cid", F.inline("hits")), scan.select("tenant", "cid", "dl")
    elif lengths is None:
        lengths = doc_lengths(chunks)
    tf = term_frequencies(occ, phrases)
    df = tf.groupBy("tenant", "phrase").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(lengths)
    asked = phrases.groupBy("tenant", "qid", "ti").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ").alias("phrase"))
    asked = asked.groupBy("tenant", "qid", "phrase").agg(F.count(F.lit(1)).alias("times"))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    norm = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    # weights once for each phrase and chunk, before they meet the queries
    weights = tf.join(df, ["tenant", "phrase"]).join(stats, "tenant").join(lengths, ["tenant", "cid"])
    weights = weights.select("tenant", "phrase", "cid", (idf * (F.col("tf") * F.lit(K1 + 1)) / norm).alias("w"))
    return asked.join(weights, ["tenant", "phrase"]).groupBy("tenant", "qid", "cid").agg(F.sum(F.col("w") * F.col("times")).alias("score"))


def top(scored: DataFrame, k: int, by: list, per: list[str], rank: str) -> DataFrame:
    """The first ``k`` rows of each ``per`` in the order ``by``, with their 0-based rank; limited before the shuffle."""
    r = F.row_number().over(W.partitionBy(*per).orderBy(*by))
    return scored.withColumn(rank, r).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def bm25_top(chunks: DataFrame, queries: DataFrame, pool: int, occ: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(tenant, qid, cid, score, fts_rank): the ``pool`` best of each query; equal scores (to nine digits) by cid."""
    scored = bm25(chunks, queries, occ, lengths).withColumn("score", F.round("score", 9))
    return top(scored, pool, [F.desc("score"), F.asc("cid")], ["tenant", "qid"], "fts_rank")


def idf(n_docs: int, df: int) -> float:
    """Inverse document frequency of a term in ``df`` of ``n_docs`` chunks, for single checks."""
    v = math.log((n_docs - df + 0.5) / (df + 0.5))
    return v if v > 0 else IDF_FLOOR
