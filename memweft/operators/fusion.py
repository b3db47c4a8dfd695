"""Rank fusion, temporal decay and diversity over the candidates of a query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank_fusion(vec: DataFrame, fts: DataFrame, rrf_k: int, keys: list[str]) -> DataFrame:
    """(keys..., cid, fused, vec_rank, fts_rank): candidates of either channel with the sum of 1/(rrf_k + rank).

    Ranks are 0-based. A candidate of one channel only has a null rank in the other.
    """
    none = F.lit(None).cast("int")
    both = vec.select(*keys, "cid", F.col("vec_rank").cast("int").alias("vec_rank"), none.alias("fts_rank")).union(fts.select(*keys, "cid", none, F.col("fts_rank").cast("int")))
    one = both.groupBy(*keys, "cid").agg(F.max("vec_rank").alias("vec_rank"), F.max("fts_rank").alias("fts_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return one.withColumn("fused", part("vec_rank") + part("fts_rank"))


def decayed(score: Column, age_days: Column, evergreen: Column, half_life_days: float) -> Column:
    """The score halved for each half-life of age; evergreen chunks and chunks of unknown age keep theirs."""
    if half_life_days <= 0:
        return score
    factor = F.exp(F.lit(-math.log(2.0) / half_life_days) * age_days)
    return F.when(F.coalesce(evergreen, F.lit(False)) | age_days.isNull(), score).otherwise(score * factor)


def ranked(fused: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Add ``i``, the 0-based rank by score; equal scores by vector rank, then keyword rank, then cid."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), F.asc("cid"))
    return fused.withColumn("i", F.row_number().over(order) - 1)


def candidates_needed(k: int) -> int:
    """How many of the best candidates diversity looks at."""
    return max(4 * k, 12)


def mmr_select(tokens: list[list[str]], k: int, lam: float) -> list[int]:
    """Indices of the k chosen candidates, in order of choice; ``tokens`` are in order of rank.

    Each step takes the candidate with the largest lam * relevance - (1 - lam) * redundancy, the lower
    rank on ties; relevance falls linearly with rank, redundancy is the largest Jaccard overlap with a
    chosen one.
    """
    n = len(tokens)
    if lam >= 1.0 or n <= k:
        return list(range(min(k, n)))
    sets = [frozenset(t) for t in tokens]
    div = np.zeros(n)
    rel = np.array([1.0 - i / n for i in range(n)])
    left, chosen = np.ones(n, bool), []
    while len(chosen) < k:
        score = np.where(left, lam * rel - (1 - lam) * div, -np.inf)
        best = int(score.argmax())
        chosen.append(best)
        left[best] = False
        for i in np.flatnonzero(left):
            both = len(sets[i] & sets[best])
            div[i] = max(div[i], both / max(1, len(sets[i]) + len(sets[best]) - both))
    return chosen


def mmr(tokens: Column, k: Column, lam: float) -> Column:
    """Arrow UDF of ``mmr_select`` over (array of each candidate's distinct tokens, k)."""

    @F.pandas_udf("array<int>")
    def run(tokens: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([mmr_select([list(t) for t in cands], int(n), lam) for cands, n in zip(tokens, k)])

    return run(tokens, k)
