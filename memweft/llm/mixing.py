"""Mixing sources to target weights by Poisson replication.

The mixture's size is as large as the repeat caps allow, times ``FILL``. From it follows how often a text
of each source must occur on average; a Poisson distribution, cut off at the source's cap, whose mean
is that rate is inverted at a uniform number hashed from the text, so every text draws its number of copies
alone and reproducibly. Copies are then shuffled globally by a hash of text and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import token_count

#: Share of the largest mixture that the caps allow. At 1 the scarcest source would repeat each text up to its cap.
FILL = 0.9
#: Draws of each source of which the one closest to its target is taken.
TRIALS = 32


def cut_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    p, below, mean = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= lam / (k + 1)
    return mean + cap * (1 - below)


def poisson_rate(mean: float, cap: int) -> float:
    """lam with cut_mean(lam, cap) = mean, by bisection; mean < cap."""
    lo, hi = 0.0, 1.0
    while cut_mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < mean else (lo, mid)
    return hi


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) hashed from columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def units(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(text_key, doc_id, source, n_tokens): each different text of a target source once, written to scratch.

    A text delivered under several ids counts as one, by its smallest doc_id, whose source it has: it must not
    occur more often than the cap because it was delivered twice. ``source`` is compared trimmed and
    in lower case; texts of other sources, of none, and null or empty texts are no part of the mixture.
    """
    source = F.lower(F.trim("source"))
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", source.alias("source"), "text")
    rows = rows.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a fixed table of a few rows
    rows = rows.select(F.md5("text").alias("text_key"), "doc_id", "source", token_count(docs.sparkSession, F.col("text"), path).alias("n_tokens"))
    one = rows.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("u"))
    return materialize(one.select("text_key", "u.*").where("n_tokens > 0"))


def rates(units: DataFrame, targets: DataFrame, fill: float = FILL) -> dict[str, dict]:
    """For each source its tokens, target share, cap, mean repetition rate and Poisson parameter.

    Targets of sources without a text are spread over the others in proportion.
    """
    have = {r["source"]: (r["t"], r["n"]) for r in units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    want = {r["source"]: (r["weight"], r["max_repeats"]) for r in targets.collect() if r["source"] in have and (r["weight"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    if not want:
        return {}
    all_weight = sum(w for w, _ in want.values())
    size = fill * min(cap * have[s][0] / (w / all_weight) for s, (w, cap) in want.items())
    out = {}
    for s, (w, cap) in want.items():
        rate = w / all_weight * size / have[s][0]
        out[s] = {"tokens": have[s][0], "texts": have[s][1], "target": w / all_weight, "cap": cap, "rate": rate, "lam": poisson_rate(rate, cap)}
    return out


def _drawn(units: DataFrame, rate: dict[str, dict]) -> tuple[DataFrame, Column]:
    """``units`` with the distribution function of its source, and the copies that a number u in [0, 1) stands for."""
    rows = []
    for s, r in rate.items():
        p, total, cdf = math.exp(-r["lam"]), 0.0, []
        for k in range(r["cap"]):
            total += p
            cdf.append(total)
            p *= r["lam"] / (k + 1)
        rows.append((s, cdf))
    table = units.sparkSession.createDataFrame(rows, "source string, cdf array<double>")
    return units.join(F.broadcast(table), "source"), lambda u: F.size(F.filter("cdf", lambda c: u >= c))  # one row a source


def seeds(units: DataFrame, rate: dict[str, dict], seed: int, trials: int = TRIALS) -> dict[str, int]:
    """For each source the seed, of ``trials`` that follow ``seed``, whose draw comes closest to the source's target size.

    Texts are of very unequal length, so single draws of a small source stray; all trials are summed in one pass.
    """
    rows, count = _drawn(units, rate)
    sums = rows.groupBy("source").agg(*[F.sum(F.col("n_tokens") * count(uniform("text_key", F.lit(seed + i)))).alias(f"t{i}") for i in range(trials)]).collect()
    return {r["source"]: seed + min(range(trials), key=lambda i: abs(r[f"t{i}"] - rate[r["source"]]["rate"] * rate[r["source"]]["tokens"])) for r in sums}


def copies(units: DataFrame, rate: dict[str, dict], seed: int = 1, trials: int = TRIALS) -> DataFrame:
    """``units`` with ``n_copies`` >= 1: the inverted distribution at the text's own uniform number.

    With ``trials`` of 1 every source has the draw of ``seed`` itself; with more, the one of its draws that is closest to its target.
    """
    rows, count = _drawn(units, rate)
    own = F.create_map(*[F.lit(x) for s, n in sorted(seeds(units, rate, seed, trials).items()) for x in (s, n)]) if rate else None
    u = uniform("text_key", own[F.col("source")]) if rate else F.lit(1.0)
    return rows.withColumn("n_copies", count(u)).where("n_copies > 0").drop("cdf")


def mix(docs: DataFrame, targets: DataFrame, fill: float = FILL, seed: int = 1, path: str | None = None) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens, text): the mixture in shuffled order.

    ``position`` is the hash that orders the mixture; rows are partitioned by it and sorted within
    partitions, so reading the output in order reads a global shuffle.
    """
    u = units(docs, targets, path)
    drawn = copies(u, rates(u, targets, fill), seed)
    body = docs.select("doc_id", "text").join(drawn, "doc_id").dropDuplicates(["text_key"])
    each = body.select("text_key", "doc_id", "source", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy"), "n_tokens", "text")
    each = each.withColumn("position", F.xxhash64("text_key", "copy", F.lit(seed), F.lit("order")))
    return each.repartition("position").sortWithinPartitions("position").select("position", "doc_id", "source", "copy", "n_tokens", "text")


def shares(docs: DataFrame, targets: DataFrame, fill: float = FILL, seed: int = 1, path: str | None = None) -> DataFrame:
    """(source, texts, tokens, mixed_tokens, most_copies, target_share, actual_share, plain_share) of each source in the mixture.

    ``plain_share`` is what the source would have if every source took its first draw, without a choice among ``TRIALS``.
    """
    u = units(docs, targets, path)
    rate = rates(u, targets, fill)
    mixed = lambda trials: copies(u, rate, seed, trials).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("t"), F.max("n_copies").alias("most_copies"))
    got, plain = ({r["source"]: (r["t"], r["most_copies"]) for r in mixed(t).collect()} for t in (TRIALS, 1))  # a row a source
    total = lambda d: sum(t for t, _ in d.values())
    share = lambda d, s: round(d[s][0] / total(d), 6) if s in d else 0.0
    rows = [(s, r["texts"], r["tokens"], *(got.get(s, (0, None))), r["target"], share(got, s), share(plain, s)) for s, r in rate.items()]
    return docs.sparkSession.createDataFrame(rows, "source string, texts long, tokens long, mixed_tokens long, most_copies int, target_share double, actual_share double, plain_share double")
