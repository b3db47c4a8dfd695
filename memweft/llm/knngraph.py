"""The most similar vectors of every vector: sharded, robust-pruned directed graphs searched by beams.

Equal vectors of a model are one node. Centroids fitted to a bounded sample cut a model's nodes into cells; cells of
more than ``SHARD`` nodes are cut again by centroids of their own, so that the number of cells follows the number of
nodes, and what is still larger is cut by hash. In each shard a directed graph is built once and written: nodes come in growing
batches, a greedy search over the graph so far proposes neighbours, robust pruning with relaxed distance (a candidate
goes if a kept neighbour is ``ALPHA`` times closer to it) keeps at most ``DEGREE`` diverse edges, and reverse edges are
pruned alike. Every node searches its own shard by beam, starting from itself. It then searches those of its nearest other
cells that can have something nearer than what it has: cells are Voronoi cells, so half the difference of the squared
distances to two centroids, over the distance between them, is how far a cell is at least. The best of all shards are merged
by exact distance and vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

#: Most nodes of a shard, nodes that a cell should have, and vectors that a fit of centroids may see.
SHARD, CELL, SAMPLE = 16384, 6144, 16384
#: Most centroids of a model; 131,072 are some 800 million nodes. Beyond, cells grow and are cut into more shards by hash.
CENTERS = 1 << 17
#: Cells that a query may look into; out-degree, pruning slack. With more slack than this, the edges of dense clusters of
#: nearly equal vectors fill up with members of the cluster, and it becomes an island.
PROBES, DEGREE, ALPHA = 3, 32, 1.05
#: Widths of the beams that build a graph, search it for its own nodes, which start where they stand, and for others.
BUILD, OWN, BEAM = 48, 32, 64
#: Where the last of a node's ``OWN`` best is not this much farther than the last that is wanted, everything is about as far
#: as everything else; there the node searches again by a beam of this width.
HARD, WIDE = 1.08, 160
#: Nodes of a search that are ranked by exact distance and id; many of a dense cluster can be at one distance.
RANKED = 32
#: Spread nodes of a shard that a query which isn't one of its nodes is compared with, and how many of them it starts from.
SPREAD, STARTS = 2048, 16
#: Queries of one shard that one task takes.
QUERIES = 65536


# --- the graph of a shard ------------------------------------------------------------------------
def _dist(x: np.ndarray, sq: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each query to its row of ids, up to the query's own square."""
    return sq[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x, sq, graph, starts, q, beam: int, width: int = 4, visited_out: bool = False):
    """(ids, distances less the query's square) of the ``beam`` best nodes for each query, best first.

    ``starts`` (len(q), s) are the entry nodes of each query. In each round every query expands its
    ``width`` best unexpanded nodes.
    """
    b, n = len(q), len(x)
    beam, width = min(beam, n), min(width, graph.shape[1])
    seen = np.zeros((b, n + 1), bool)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), n, np.int64)
    d = np.full((b, beam), np.inf, np.float32)
    s = starts.shape[1]
    seen[rows, starts] = True
    ids[:, :s] = starts
    d[:, :s] = _dist(x, sq, q, starts)
    if s > 1:  # the same start twice; then best first
        order = np.argsort(ids[:, :s], axis=1)
        st = np.take_along_axis(ids[:, :s], order, 1)
        twin = np.zeros((b, s), bool)
        np.put_along_axis(twin, order[:, 1:], st[:, 1:] == st[:, :-1], 1)
        d[:, :s][twin] = np.inf
        order = np.argsort(d[:, :s], axis=1, kind="stable")
        ids[:, :s], d[:, :s] = np.take_along_axis(ids[:, :s], order, 1), np.take_along_axis(d[:, :s], order, 1)
    done = np.zeros((b, beam), bool)
    slot = np.zeros((b, n + 1), np.int16)
    live = np.arange(b)
    while len(live):
        open_ = ~done[live] & np.isfinite(d[live])
        # the best unexpanded come first, as rows are sorted
        pick = open_ & (np.cumsum(open_, 1, dtype=np.int16) <= width)
        has = pick.any(1)
        live, pick = live[has], pick[has]
        if not len(live):
            break
        done[live] |= pick
        at, col = np.nonzero(pick)
        nodes = np.full((len(live), width), n)
        nodes[at, np.cumsum(pick, 1, dtype=np.int16)[at, col] - 1] = ids[live][at, col]
        near = graph[nodes].reshape(len(live), -1)
        r = live[:, None]
        # not seen before, no padding, and of a node that two expanded nodes share one: the one whose mark stays
        mark = np.arange(near.shape[1], dtype=np.int16)[None, :]
        slot[r, near] = mark
        fresh = ~seen[r, near] & (near != n) & (slot[r, near] == mark)
        seen[r, near] = True
        at, col = np.nonzero(fresh)
        if not len(at):
            continue
        new = near[at, col]
        cd = np.full(near.shape, np.inf, np.float32)
        cd[at, col] = sq[new] - 2 * np.einsum("ij,ij->i", x[new], q[live[at]])
        alld = np.concatenate([d[live], cd], 1)
        top = np.argpartition(alld, beam - 1, axis=1)[:, :beam]
        td = np.take_along_axis(alld, top, 1)
        top = np.take_along_axis(top, np.argsort(td, axis=1, kind="stable"), 1)
        d[live] = np.take_along_axis(alld, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), top, 1)
    return ids, d


def robust_prune(x, sq, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of its candidates (n is padding)."""
    n, c = len(x), cand.shape[1]
    bad = (cand == n) | (cand == own[:, None])
    safe = np.where(bad, 0, cand)
    v = x[safe]
    p = x[own]
    d = sq[safe] - 2 * np.matmul(v, p[:, :, None])[:, :, 0] + sq[own][:, None]
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, safe = np.take_along_axis(d, order, 1), np.take_along_axis(safe, order, 1)
    v = x[safe]
    s = sq[safe]
    between = s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    alive[:, 1:] &= safe[:, 1:] != safe[:, :-1]  # equal ids stand side by side or are dropped below at distance 0
    out = np.full((len(own), degree), n, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        j = alive.argmax(1)
        out[has, k] = safe[rows, j][has]
        kept = between[rows, j]
        alive &= alpha * alpha * kept > d
        alive[rows, j] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, int]:
    """(neighbours of each node padded with n, entry node): the graph of the rows of ``x``."""
    n = len(x)
    sq = np.einsum("ij,ij->i", x, x)
    graph = np.full((n + 1, degree), n, np.int64)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 8
    while at < n:
        part = order[at : at + min(size, batch)]
        b = len(part)
        ids, _ = beam_search(x, sq, graph, np.full((b, 1), entry), x[part], beam)
        # points of one batch don't find each other by search; the closest of them are proposed too
        own = sq[part][None, :] - 2 * x[part] @ x[part].T
        np.fill_diagonal(own, np.inf)
        k = min(8, b - 1)
        if k:
            ids = np.concatenate([ids, part[np.argpartition(own, k - 1, axis=1)[:, :k]]], 1)
        graph[part] = robust_prune(x, sq, part, ids, degree, alpha)
        # reverse edges: appended where there is room, else pruned together with what is there
        src = np.repeat(part, degree)
        dst = graph[part].ravel()
        ok = dst < n
        src, dst = src[ok], dst[ok]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = min(int(count.max()), 2 * degree)
        add = np.full((len(nodes), most), n, np.int64)
        inner = np.arange(len(dst)) - np.repeat(first, count)
        fits = inner < most
        add[np.repeat(np.arange(len(nodes)), count)[fits], inner[fits]] = src[fits]
        have = (graph[nodes] < n).sum(1)
        room = have + count <= degree
        for i in np.flatnonzero(room):
            graph[nodes[i], have[i] : have[i] + count[i]] = src[first[i] : first[i] + count[i]]
        full = np.flatnonzero(~room)
        for s in range(0, len(full), 512):
            f = full[s : s + 512]
            graph[nodes[f]] = robust_prune(x, sq, nodes[f], np.concatenate([graph[nodes[f]], add[f]], 1), degree, alpha)
        at += b
        size *= 2
    return graph, entry


def search(x, graph, entry: int, q: np.ndarray, self_at: np.ndarray, beam: int = BEAM, batch: int = 512) -> np.ndarray:
    """Ids of the ``beam`` best nodes of each query. ``self_at`` is the query's own node, or -1.

    A query that is a node starts there; others start at the entry and the best ``STARTS`` of ``SPREAD`` spread nodes.
    """
    n = len(x)
    beam = min(beam, n)
    sq = np.einsum("ij,ij->i", x, x)
    spread = np.unique(np.linspace(0, n - 1, min(n, SPREAD)).astype(int))
    some = min(STARTS, len(spread), beam - 1)
    out = np.full((len(q), beam), n, np.int64)
    for s in range(0, len(q), batch):
        part = q[s : s + batch]
        own = self_at[s : s + batch, None]
        if some and (own < 0).all():
            d = sq[spread][None, :] - 2 * part @ x[spread].T
            near = spread[np.argpartition(d, some - 1, axis=1)[:, :some]]
            starts = np.column_stack([np.full(len(part), entry), near])
        else:
            starts = np.where(own >= 0, own, entry)
        out[s : s + len(part)], _ = beam_search(x, sq, graph, starts, part, beam)
    return out


# --- the operator --------------------------------------------------------------------------------
def usable(cache: DataFrame, models: DataFrame) -> DataFrame:
    """(model, vec_id, vec) once for each vec_id with a usable vector.

    Usable: the model is known, the length is its dimension, no component is null, NaN or infinite, and
    not all are zero. Of repeated rows that differ the greatest vector counts.
    """
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    dims = models.where(F.col("dim") > 0).groupBy("model").agg(F.max("dim").alias("dim"))
    rows = cache.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).select("model", "vec_id", "vec").join(dims, "model")
    good = rows.where((F.size("vec") == F.col("dim")) & finite & F.exists("vec", lambda v: v != 0))
    return good.dropDuplicates(["model", "vec_id", "vec"]).groupBy("model", "vec_id").agg(F.max("vec").alias("vec"))


def _centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None, :] - 2 * sample @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], sample[rng.choice(len(sample), k)])
    return c.astype(np.float32)


class Cells:
    """The cells of a model: coarse centroids, and leaves, each below one of them."""

    def __init__(self, coarse: np.ndarray, leaves: list[np.ndarray] | None = None):
        self.coarse = coarse
        leaves = leaves or [c[None] for c in coarse]
        self.leaf = np.concatenate(leaves).astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])

    def nearest(self, x: np.ndarray, probes: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each row its nearest leaves, its own first, and how far the cell of each is at least.

        A row's own leaf is the nearest below its nearest coarse centroid; others are taken from below its nearest ``probes``
        coarse ones. Distances to the cells of other coarse centroids are bounded by those, to its own by the leaves.
        """
        d = (self.coarse.astype(float) ** 2).sum(1)[None, :] - 2 * x.astype(float) @ self.coarse.T.astype(float)
        some = min(probes, len(self.coarse))
        top = np.argsort(d, axis=1, kind="stable")[:, :some] if some == len(self.coarse) else np.argpartition(d, some - 1, axis=1)[:, :some]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)
        # cells that aren't cut again, all rows at once
        apart = np.sqrt(((self.coarse[top].astype(float) - self.coarse[top[:, :1]].astype(float)) ** 2).sum(2))
        dist = np.take_along_axis(d, top, 1)
        gap = np.divide(dist - dist[:, :1], 2 * apart, out=np.zeros_like(dist), where=apart > 0)
        ids, gaps = list(self.first[top].astype(np.int32)), list(np.maximum(0, gap))
        for row in np.flatnonzero((np.diff(self.first)[top] > 1).any(1)):
            cells = top[row]
            near = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in cells])
            parent = np.repeat(cells, self.first[cells + 1] - self.first[cells])
            v = self.leaf[near].astype(float)
            e = (v * v).sum(1) - 2 * v @ x[row].astype(float)
            inside = parent == cells[0]
            own = int(np.flatnonzero(inside)[e[inside].argmin()])
            a, b = np.where(inside, e, d[row, parent]), np.where(inside, e[own], d[row, cells[0]])
            here = np.where(inside[:, None], v[own], self.coarse[cells[0]].astype(float))
            there = np.where(inside[:, None], v, self.coarse[parent].astype(float))
            apart = np.sqrt(((there - here) ** 2).sum(1))
            gap = np.divide(a - b, 2 * apart, out=np.zeros(len(a)), where=apart > 0)
            e[own] = -np.inf
            order = np.argsort(e, kind="stable")[:probes]
            ids[row], gaps[row] = near[order].astype(np.int32), np.maximum(0, gap[order])
        return ids, gaps


def partition(nodes: DataFrame) -> dict[str, Cells]:
    """The cells of each model, fitted to bounded samples of its nodes by hash of the node, in two levels."""
    sizes = {r["model"]: r["n"] for r in nodes.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    share = lambda n: F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < F.ceil(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / n) * (1 << 30))
    for model, n in sorted(sizes.items()):
        own = nodes.where(F.col("model") == model)
        k = max(1, min(round(n / CELL), SAMPLE // 8))
        sample = np.stack(own.where(share(F.lit(float(n)))).select("node", "vec").limit(2 * SAMPLE).toPandas().sort_values("node")["vec"].tolist() or [own.select("vec").first()["vec"]]).astype(np.float32)
        coarse = _centroids(sample, min(k, len(sample))) if k > 1 else np.zeros((1, sample.shape[1]), np.float32)
        out[model] = Cells(coarse)
    bc = nodes.sparkSession.sparkContext.broadcast(out)  # at most SAMPLE // 8 centroids a model

    def place(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for model, part in pdf.groupby("model").indices.items():
                c = bc.value[model].coarse
                x = np.stack(pdf["vec"].to_numpy()[part]).astype(float)
                cell[part] = np.argmin((c.astype(float) ** 2).sum(1)[None, :] - 2 * x @ c.T.astype(float), axis=1)
            yield pdf[["model", "node", "vec"]].assign(cell=cell)

    def split(pdf):
        x = np.stack(pdf.sort_values("node")["vec"].tolist()).astype(np.float32)
        k = min(int(pdf["k"].iloc[0]), max(1, len(x) // 8))
        return pd.DataFrame({"model": pdf["model"].iloc[0], "cell": pdf["cell"].iloc[0], "center": list(_centroids(x, k))})

    # if every cell's size is near its share, there is nothing to cut again
    if any(n > SHARD for n in sizes.values()):
        placed = materialize(nodes.mapInPandas(place, "model string, node string, vec array<float>, cell int"))
        counts = placed.groupBy("model", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
        most = F.lit(CENTERS // (SAMPLE // 8))
        large = counts.withColumn("k", F.least(F.ceil(F.col("n") / CELL), most, F.lit(SAMPLE // 8)))
        rows = placed.join(F.broadcast(large), ["model", "cell"]).where(share(F.col("n"))).select("model", "cell", "node", "vec", "k")  # a row a cell
        cut: dict = {}
        for r in rows.groupBy("model", "cell").applyInPandas(split, "model string, cell int, center array<float>").collect():  # at most CENTERS a model
            cut.setdefault((r["model"], r["cell"]), []).append(r["center"])
        for model, cells in out.items():
            leaves = [np.array(sorted(cut[model, i]), np.float32) if (model, i) in cut else c[None] for i, c in enumerate(cells.coarse)]
            out[model] = Cells(cells.coarse, leaves)
    return out


def _node() -> F.Column:
    """128 bits that name a vector's value."""
    return F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "vec")))


FOUND = "model string, node string, d array<double>, id array<long>"
GRAPH = "model string, cell int, shard int, dim int, x binary, graph binary, entry int, nodes array<string>, asked array<boolean>, sizes array<int>, ids array<long>"


class _Shard:
    """A shard as it is written: its vectors, its graph, and the vec_ids of its nodes."""

    def __init__(self, row):
        self.x = np.frombuffer(row["x"], np.float32).reshape(-1, row["dim"])
        n = len(self.x)
        self.graph, self.entry = np.frombuffer(row["graph"], np.int32).reshape(n + 1, -1).astype(np.int64), int(row["entry"])
        sizes = np.asarray(row["sizes"])
        self.table = np.full((n + 1, int(sizes.max())), np.iinfo(np.int64).max)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.table[np.repeat(np.arange(n), sizes), at] = np.asarray(row["ids"])

    def best(self, y: np.ndarray, near: np.ndarray, keep: int) -> tuple[list, list]:
        """For each query of ``y`` the ``keep`` best vec_ids of its nodes in ``near``, by exact distance and id."""
        n, dd, ii = len(self.x), [], []
        width = self.table.shape[1]
        for s in range(0, len(y), 2048):
            part = near[s : s + 2048]
            safe = np.where(part < n, part, 0)
            d = ((self.x[safe].astype(float) - y[s : s + 2048, None, :]) ** 2).sum(2)
            d[part >= n] = np.inf
            d, v = np.repeat(d, width, axis=1), self.table[part].reshape(len(part), -1)
            d[v == np.iinfo(np.int64).max] = np.inf
            order = np.lexsort((v, d), axis=1)[:, :keep]
            d, v = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
            for a, c in zip(d, v):
                ok = np.isfinite(a)
                dd.append(a[ok])
                ii.append(c[ok])
        return dd, ii


def graphs(base: DataFrame) -> DataFrame:
    """A row for each shard of ``base`` (model, cell, shard, node, vec, ids, asked) with its graph, written to scratch."""

    def run(pdf):
        pdf = pdf.sort_values("node")
        x = np.stack(pdf["vec"].tolist()).astype(np.float32)
        graph, entry = build(x, degree=min(DEGREE, max(1, len(x) - 1)))
        return pd.DataFrame({
            "model": pdf["model"].iloc[:1], "cell": pdf["cell"].iloc[:1], "shard": pdf["shard"].iloc[:1], "dim": x.shape[1], "x": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": entry,
            "nodes": [pdf["node"].tolist()], "asked": [pdf["asked"].tolist()], "sizes": [pdf["ids"].map(len).tolist()], "ids": [np.concatenate(pdf["ids"].tolist())],
        })

    return materialize(base.groupBy("model", "cell", "shard").applyInPandas(run, GRAPH))


def _own(batches, keep: int):
    """What the asked nodes of each shard find in it, starting where they stand."""
    for pdf in batches:
        for row in pdf.to_dict("records"):
            ask = np.flatnonzero(np.asarray(row["asked"], bool))
            if len(ask):
                s = _Shard(row)
                ranked = max(RANKED, 2 * keep)
                near = search(s.x, s.graph, s.entry, s.x[ask], ask, max(OWN, ranked))[:, :ranked]
                if near.shape[1] > keep:
                    some = np.where(near[:, [keep - 1, -1]] < len(s.x), near[:, [keep - 1, -1]], 0)
                    d = ((s.x[some] - s.x[ask, None, :]) ** 2).sum(2)
                    hard = np.flatnonzero((near[:, -1] < len(s.x)) & (d[:, 1] < HARD**2 * d[:, 0]))
                    if len(hard):
                        near[hard] = search(s.x, s.graph, s.entry, s.x[ask[hard]], ask[hard], max(WIDE, ranked))[:, : near.shape[1]]
                d, i = s.best(s.x[ask], near, keep)
                yield pd.DataFrame({"model": row["model"], "node": np.asarray(row["nodes"], object)[ask], "d": d, "id": i})


def neighbours(cache: DataFrame, models: DataFrame, k: int = 5, queries=None, exact: bool = False, probes: int = PROBES, beam: int = BEAM) -> DataFrame:
    """(model, vec_id, near): the k nearest other usable vectors of the same model, nearest first.

    near is an array of (d, id): squared Euclidean distance and vec_id, ties by smaller vec_id. Models
    with fewer than k + 1 usable vectors give as many as there are. ``queries`` is a condition on the
    vec_id of the query vectors (default: all). ``exact`` scans all shards of the model by block
    instead of searching graphs, for measuring recall.
    """
    spark = cache.sparkSession
    vecs = materialize(usable(cache, models))
    # equal vectors are one node: a hot vector costs its task one row per map task
    keep = k + 1
    vecs = vecs.withColumn("node", _node())
    first = F.row_number().over(W.partitionBy("model", "node").orderBy("vec_id"))  # limited before the shuffle
    few = vecs.withColumn("r", first).where(F.col("r") <= keep)
    nodes = materialize(few.groupBy("model", "node").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    cells = spark.sparkContext.broadcast(partition(nodes))  # at most CENTERS centroids a model

    def assign(batches):
        for pdf in batches:
            own, gaps = np.empty(len(pdf), object), np.empty(len(pdf), object)
            for model, part in pdf.groupby("model").indices.items():
                for at, c, g in zip(part, *cells.value[model].nearest(np.stack(pdf["vec"].to_numpy()[part]).astype(np.float32), probes)):
                    own[at], gaps[at] = c, g
            yield pdf.assign(cells=own, gaps=gaps)

    placed = nodes.mapInPandas(assign, "model string, node string, vec array<float>, ids array<long>, cells array<int>, gaps array<double>")
    asked = F.lit(True)
    if queries is not None:
        placed = placed.join(vecs.where(queries).select("model", "node", F.lit(True).alias("asked")).distinct(), ["model", "node"], "left")
        asked = F.coalesce("asked", F.lit(False))
    placed = materialize(placed.withColumn("asked", asked).withColumn("cell", F.col("cells")[0]))
    sizes = placed.groupBy("model", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    shards = materialize(sizes)  # a row a cell
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    made = graphs(placed.join(shards, ["model", "cell"]).select("model", "cell", shard.alias("shard"), "node", "vec", "ids", "asked"))
    ask = placed.where("asked").select("model", "node", "vec", "cell", "cells", "gaps")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    if exact:
        due = ask.drop("cell").join(shards, "model").select("model", "node", "vec", "cell", every)
        own = None
    else:
        own = materialize(made.mapInPandas(lambda b: _own(b, keep), FOUND))
        # the k-th distance of what a node has, as a bound for what others must beat; rounding must not cut off an equal one
        limit = own.select("model", "node", F.when(F.size("d") >= keep, F.sqrt(F.element_at("d", keep)) * (1 + 1e-6)).otherwise(F.lit(float("inf"))).alias("limit"))
        looks = ask.join(limit, ["model", "node"]).select("model", "node", "vec", F.col("cell").alias("home"), "limit", F.explode(F.arrays_zip("cells", "gaps")).alias("p"))
        looks = looks.where(F.col("p.gaps") <= F.col("limit")).select("model", "node", "vec", "home", F.col("p.cells").alias("cell")).join(shards, ["model", "cell"])
        due = looks.select("model", "node", "vec", "home", "cell", "shards", every).where((F.col("cell") != F.col("home")) | (F.col("shard") != shard)).select("model", "node", "vec", "cell", "shard")

    def others(key, g, q):
        if not len(g) or not len(q):
            return pd.DataFrame({"model": [], "node": [], "d": [], "id": []})
        s, y = _Shard(g.iloc[0]), np.stack(q["vec"].tolist()).astype(np.float32)
        most = min(len(s.x), max(RANKED, 2 * keep) * (2 if exact else 1))
        if exact:
            sq = np.einsum("ij,ij->i", s.x, s.x)
            near = np.concatenate([np.argpartition(sq[None, :] - 2 * y[i : i + 512] @ s.x.T, most - 1, axis=1)[:, :most] for i in range(0, len(y), 512)])
        else:
            near = search(s.x, s.graph, s.entry, y, np.full(len(y), -1), beam)[:, :most]
        d, i = s.best(y, near, keep)
        return pd.DataFrame({"model": key[0], "node": q["node"].to_numpy(), "d": d, "id": i})

    due = materialize(due)
    blocks = due.groupBy("model", "cell", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))  # a row a shard
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    left = made.select("model", "cell", "shard", "dim", "x", "graph", "entry", "sizes", "ids").join(blocks, ["model", "cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = due.join(blocks, ["model", "cell", "shard"]).select(*[F.col(c).alias(f"q{c}") for c in ("model", "cell", "shard")], block.alias("qblock"), "node", "vec")
    found = left.groupBy("model", "cell", "shard", "block").cogroup(right.groupBy("qmodel", "qcell", "qshard", "qblock")).applyInPandas(others, FOUND)
    found = found if own is None else own.unionByName(found)
    pairs = F.arrays_zip("d", "id")
    best = found.select("model", "node", pairs.alias("p")).groupBy("model", "node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, keep).alias("p"))
    rows = (vecs if queries is None else vecs.where(queries)).select("model", "vec_id", "node").join(best, ["model", "node"])
    return rows.select("model", "vec_id", F.slice(F.filter("p", lambda e: e["id"] != F.col("vec_id")), 1, k).alias("near"))


def found(cache: DataFrame, models: DataFrame, k: int = 5) -> DataFrame:
    """p3_found: (vec_id, near_id), directed."""
    return neighbours(cache, models, k).select("vec_id", F.explode("near").alias("e")).select("vec_id", F.col("e.id").alias("near_id"))


def recall(cache: DataFrame, models: DataFrame, k: int = 5) -> DataFrame:
    """(model, n_queries, recall): the share of true neighbours found for all vec_ids divisible by 100."""
    ask = F.col("vec_id") % 100 == 0
    got = neighbours(cache, models, k, ask).select("model", "vec_id", F.transform("near", lambda e: e["id"]).alias("got"))
    true = neighbours(cache, models, k, ask, exact=True).select("model", "vec_id", F.transform("near", lambda e: e["id"]).alias("true"))
    both = true.join(got, ["model", "vec_id"], "left")
    hit = F.size(F.array_intersect("true", F.coalesce("got", F.array().cast("array<bigint>"))))
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("n_queries"), F.try_divide(F.sum(hit), F.sum(F.size("true"))).alias("recall"))
