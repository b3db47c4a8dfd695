"""Filling containers of fixed capacity: minimum bin slack over the histogram of lengths.

Only how many items have which length matters for a good packing, and there are at most as many
lengths as the capacity. So the plan is made on the driver from that bounded histogram: the longest
remaining length opens a container, a bitset subset-sum over the remaining multiset of lengths finds the
sum closest to the room that is left, backtracking gives the counts, and the pattern is repeated as often
as the counts allow. If that leaves more than ``SLACK`` above a proven lower bound, plans that open containers
by any length over half the capacity, in a seeded order, are made too, and the one with the fewest containers
is taken. The items themselves stay distributed: each gets its rank among the items of its length and finds
its container from the plan by that rank.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import token_count

#: Items of one length that one task ranks; lengths of more items are cut into parts of this size on average.
PART = 100_000
#: Further plans that are tried, and the share above the lower bound at which none is.
TRIES, SLACK = 6, 0.001


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many items of which length fill ``room`` as far as possible; bounded by ``counts``.

    Bit t of ``reach`` says that a sum of t can be reached; lengths are added from the longest on
    until the room can be filled exactly or all have been.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        steps.append((size, reach))
        left, block = min(counts[size], room // size), 1
        while left > 0:  # multiples of 1, 2, 4 ... items
            block = min(block, left)
            reach |= (reach << (size * block)) & mask
            left -= block
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {}
    for size, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            used[size] = n
    return used


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing can go below.

    The largest bound of dual feasible functions: with (k + 1) * size not a multiple of the capacity, a length counts
    floor((k + 1) * size / capacity) / k of a container, else its own share; lengths over capacity - e count whole where
    those under e count nothing.
    """
    size, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    best = -(-int((size * n).sum()) // capacity)
    edges = sorted({0, *(int(s) for s in size if 2 * s <= capacity)})[-64:]
    for k in range(1, 41):
        whole, rest = np.divmod((k + 1) * size, capacity)
        worth = np.where(rest == 0, k * size, whole * capacity)  # times k * capacity
        for e in edges:
            w = np.where(size > capacity - e, k * capacity, np.where(size < e, 0, worth))
            best = max(best, -(-sum(int(a) * int(b) for a, b in zip(w, n)) // (k * capacity)))
    return best


def _planned(counts: dict[int, int], capacity: int, opener, share: int) -> list[tuple[int, dict[int, int]]]:
    """One plan: ``opener`` picks the length that opens a container; a pattern takes 1/``share`` of what it could."""
    counts = {s: n for s, n in counts.items() if n > 0}
    out = []
    while counts:
        top = opener(counts)
        rest = dict(counts)
        rest[top] -= 1
        used = fill(capacity - top, rest)
        used[top] = used.get(top, 0) + 1
        times = -(-min(counts[s] // n for s, n in used.items()) // share)
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
        out.append((times, used))
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: items of it in one container}) so that all items are placed.

    Each step leaves some length with fewer items than the pattern needs, or takes half of what it could, so that
    the number of steps is bounded by capacity * log(items).
    """
    if not any(counts.values()):
        return []
    size = lambda p: sum(t for t, _ in p)
    best, least = _planned(counts, capacity, max, 1), None
    for seed in range(TRIES):
        if size(best) <= (1 + SLACK) * (least := least or least_bins(counts, capacity)):
            break
        rng = random.Random(seed)
        other = _planned(counts, capacity, lambda c: rng.choice([s for s in c if 2 * s > capacity] or [max(c)]), 2)
        best = min(best, other, key=size)
    return best


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of documents with at least one token, written to scratch. Null ids and texts drop out."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", token_count(docs.sparkSession, F.col("text"), path).alias("n_tokens"))
    return materialize(rows.where("n_tokens > 0"))


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens): every document of ``sizes`` (doc_id, n_tokens) placed in containers.

    A document of at most ``capacity`` tokens is one piece (piece 0). A longer one is cut into pieces of
    ``capacity`` tokens, each a full container, and one for what is left. Rows delivered twice are
    placed twice. Bins are numbered from 0.
    """
    cut = F.when(F.col("n_tokens") > capacity, F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")).otherwise(F.array(F.lit(0).cast("long")))
    items = sizes.select("doc_id", "n_tokens", F.explode(cut).alias("piece"))
    items = items.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("size"))
    counts = {int(r["size"]): int(r["n"]) for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    # ranks among equal lengths: within parts of a length, as many as its count asks for, plus the counts of the parts before
    spark = sizes.sparkSession
    hot = spark.createDataFrame([(s, -(-n // PART)) for s, n in counts.items() if n > PART], "size long, salts int")  # at most ``capacity`` rows
    salts = F.coalesce("salts", F.lit(1))
    items = items.join(F.broadcast(hot), "size", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int")).drop("salts")
    parts = items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    parts = parts.select("size", "salt", before.alias("before")).where("before > 0")
    # for each length: from which rank on its items go to which containers, how many in each
    table: dict[int, list] = {}
    taken = dict.fromkeys(counts, 0)
    first = 0
    for times, used in plan(counts, capacity):
        for s, n in used.items():
            table.setdefault(s, []).append((taken[s], first, n))
            taken[s] += n * times
        first += times
    bc = sizes.sparkSession.sparkContext.broadcast({s: np.array(v, np.int64) for s, v in table.items()})

    def place(batches):
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            out = np.zeros(len(pdf), np.int64)
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.r_[True, size[order][1:] != size[order][:-1], True]) if len(pdf) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                at = order[i:j]
                t = bc.value[int(size[at[0]])]
                k = np.searchsorted(t[:, 0], rank[at], "right") - 1
                out[at] = t[k, 1] + (rank[at] - t[k, 0]) // t[k, 2]
            yield pd.DataFrame({"bin_id": out, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": size})

    own = F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("own", own)
    if any(n > PART for n in counts.values()):
        ranked = ranked.join(parts, ["size", "salt"], "left").withColumn("own", F.col("own") + F.coalesce("before", F.lit(0)))
    ranked = ranked.select("doc_id", "piece", "size", F.col("own").alias("rank"))
    return ranked.mapInPandas(place, "bin_id long, doc_id long, piece long, n_tokens long")


def pack_all(docs: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """(container, bin_id, doc_id, piece, n_tokens) for every capacity of ``limits`` (a fixed table of a few rows)."""
    sizes = measured(docs, path)
    out = None
    for r in limits.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("capacity_tokens", "container").collect():
        one = pack(sizes, r["capacity_tokens"]).select(F.lit(r["container"]).alias("container"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "container string, bin_id long, doc_id long, piece long, n_tokens long")
    return out


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(container, capacity, bins, least_bins, tokens, filled): how full the containers are.

    ``least_bins`` is what no packing can beat: all tokens over the capacity, rounded up.
    """
    caps = limits.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), (F.max("bin_id") + 1).alias("bins"))
    return bins.join(caps, "container").select("container", "capacity", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))


def invariants(docs: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """(container, docs, fits, whole, complete): documents placed, and whether what must hold of a packing does.

    ``fits``: no bin has more than the capacity. ``whole``: a document of at most the capacity is in one piece, and a longer
    one in as few as it can be. ``complete``: the pieces of each document have its tokens.
    """
    sizes = measured(docs, path).groupBy("doc_id").agg(F.sum("n_tokens").alias("size"))
    caps = limits.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()  # a few rows
    packed = materialize(pack_all(docs, limits, path))
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(caps), "container")
    fits = bins.groupBy("container").agg(F.bool_and(F.col("t") <= F.col("capacity")).alias("fits"))
    per = packed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id").join(F.broadcast(caps), "container")
    got = per.groupBy("container").agg(F.count(F.lit(1)).alias("docs"), F.bool_and(F.col("pieces") == F.ceil(F.col("size") / F.col("capacity"))).alias("whole"), F.bool_and(F.col("t") == F.col("size")).alias("complete"))
    return got.join(fits, "container").select("container", "docs", "fits", "whole", "complete")
