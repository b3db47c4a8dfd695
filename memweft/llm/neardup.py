"""Near-duplicate records with small edits: Order MinHash over occurrence-labelled word k-mers.

A record's sketch j keeps its ``ELL`` smallest occurrence-labelled k-mers under hash j, in text
order; records that agree in a whole sketch are candidates. Edits that keep most k-mers and most of
their order keep many sketches. k-mers are drawn with odds inverse to their document frequency (an
exponential race), because stock phrases say nothing about identity; only k-mers common enough to be
one of at most ``HOT`` heavy hitters need a weight, so what is broadcast has a fixed bound.

Candidates are verified by banded alignment of their word sequences: an edit changes at most k of a text's k-mers, so
few edits prove that the sets have enough in common. Where the alignment proves nothing, as blocks were moved or
edits are many, the exact Jaccard similarity of the sets decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from . import vectext as V
from .canonical import canonical_hashes
from .components import components
from .repeats import cells_for, maybe_repeated, merged_counts

#: Words in a k-mer and the least similarity, as the data's statement of the problem has them.
K, THRESHOLD = 3, 0.6
#: Sketches for each record, and k-mers in a sketch. Pairs that agree in no sketch are lost: over the true
#: pairs of sf0.1, 0.0155 % are to be expected with 18 sketches, 0.0097 % with 20, 0.0002 % with 40.
SKETCHES, ELL = 40, 2
#: Bits to which a set's k-mers are hashed, to tell most pairs that can't reach the threshold without their texts.
BITS = 512
#: At most so many k-mers have a weight of their own.
HOT = 1 << 17
#: Buckets of more classes than this take the exact prefix path.
CROWD = 64
#: Classes of more chunks than this are cut into parts when pairs are expanded.
PART = 1000


def heavy_kmers(texts: DataFrame, k: int = K, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and relative weights (<= 1) of the common k-mers of the whole table.

    Each task counts the k-mers of all its texts and sends those that make up more than 1/(2*hot) of
    them, so a k-mer's total is short by less than 1/(2*hot) of all; kept are those above 1/hot of all
    k-mers, hence fewer than ``hot``.
    """

    def count(batches):
        have, times, total = np.empty(0, V.U), np.empty(0, np.int64), 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in V.blocks(texts, 4_000_000):
                h, _ = V.shingles(*V.words(texts[i:j]), k)
                total += len(h)
                u, n = np.unique(h, return_counts=True)
                u, at = np.unique(np.concatenate([have, u]), return_inverse=True)
                n = np.bincount(at, np.concatenate([times, n]), len(u)).astype(np.int64)
                if len(u) > 8 * hot:  # lossy counting: what is rare so far can't be heavy by much
                    keep = n > total // (8 * hot)
                    u, n = u[keep], n[keep]
                have, times = u, n
        keep = times > max(1, total // (2 * hot))
        yield pd.DataFrame({"h": np.append(have[keep].view(np.int64), 0), "n": np.append(times[keep], 0), "total": np.append(np.zeros(keep.sum(), np.int64), total)})

    parts = materialize(texts.select("text").mapInPandas(count, "h long, n long, total long"))
    total = parts.agg(F.sum("total")).first()[0] or 0
    least = max(8, total // hot)
    got = parts.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas()
    h = got["h"].to_numpy(np.int64).view(V.U)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(float)[order] / least


def _segments(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and each element's run."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    return first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))


def order_sketches(texts: list[str], heavy, k: int = K, sketches: int = SKETCHES, ell: int = ELL):
    """For each text with a k-mer: (index, distinct k-mers, two signatures of their set, its bits, sketch hashes)."""
    hot, weight = heavy
    h, doc = V.shingles(*V.words(texts), k)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, V.U), np.empty(0, V.U), np.empty((0, BITS // 64), np.int64), np.empty((0, sketches), V.U)
    # occurrence labels: the n-th time that this text has this k-mer
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]
    run = np.flatnonzero(new)
    nth = np.arange(len(hs)) - np.repeat(run, np.diff(np.r_[run, len(hs)]))
    occ = np.empty(len(h), V.U)
    occ[order] = nth.astype(V.U)
    label = V.mix(h + occ * V.U(0xD6E8FEB86659FD93))
    # the set of distinct k-mers, as a count and two order-free sums
    ids = ds[new]
    seg, _ = _segments(ids)
    which, size = ids[seg], np.diff(np.r_[seg, len(ids)])
    sums = [np.add.reduceat(V.mix(hs[new] + V.U(s)), seg) for s in (11, 12)]
    # bits that the set's k-mers hash to: what one set has and another lacks is at least what its bits show
    seen = np.zeros((len(which), BITS), bool)
    seen[np.repeat(np.arange(len(seg)), size), (V.mix(hs[new] + V.U(13)) & V.U(BITS - 1)).astype(np.int64)] = True
    bits = np.packbits(seen, axis=1).view(np.int64)
    # exponential race, in the form u ** cost: the larger the value, the earlier the k-mer
    common = np.empty(0, np.int64)
    if len(hot):
        at = np.searchsorted(hot, h).clip(max=len(hot) - 1)
        common = np.flatnonzero(hot[at] == h)
        power = weight[at[common]]
    first, _ = _segments(doc)
    out = np.empty((len(first), sketches), V.U)
    place = np.arange(len(h), dtype=V.U)[::-1]  # of ties the first
    for j in range(0, sketches, 2):
        # each half of a hash draws for one sketch; the value and the place in one number, so that one maximum gives both
        x = V.mix(label ^ V.U(0xA0761D6478BD642F * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        for half, draw in enumerate((x >> V.U(32), x & V.U(0xFFFFFFFF))[: sketches - j]):
            if len(common):
                e = draw.astype(np.float32) * np.float32(2.0**-32)
                e[common] **= power
                draw = e.view(np.uint32).astype(V.U)
            key = draw << V.U(32) | place
            picks = []
            for _ in range(ell):
                pick = len(h) - 1 - (np.maximum.reduceat(key, first) & V.U(0xFFFFFFFF)).astype(np.int64)
                picks.append(pick)
                key[pick] = place[pick]
            picks = np.sort(np.stack(picks), axis=0)
            acc = np.full(len(first), V.U(j + half + 1))
            for p in picks:
                acc = V.mix(acc * V.U(3) + label[p])
            out[:, j + half] = acc
    return which, size, *sums, bits, out


def sketch_table(chunks: DataFrame, k: int = K, sketches: int = SKETCHES, ell: int = ELL, hot: int = HOT) -> DataFrame:
    """(cid, key, cls, n_set, bits, sketch): every chunk that has at least one k-mer, written to scratch.

    ``cls`` names the class of chunks with the same canonical key and the same k-mer set. Chunks of one
    class have the same similarity to all others.
    """
    usable = chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", "text")
    heavy = chunks.sparkSession.sparkContext.broadcast(heavy_kmers(usable, k, hot))

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in V.blocks(texts):
                which, size, s1, s2, bits, sk = order_sketches(texts[i:j], heavy.value, k, sketches, ell)
                if not len(which):
                    continue
                part = pdf.iloc[i:j].iloc[which]
                key = canonical_hashes(part["text"].tolist())
                yield pd.DataFrame({"cid": part["cid"], "key": key.view(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "n_set": size, "bits": list(bits), "sketch": list(sk.view(np.int64))})

    rows = usable.mapInPandas(run, "cid string, key long, s1 long, s2 long, n_set long, bits array<long>, sketch array<long>")
    return materialize(rows.select("cid", "key", F.xxhash64("key", "s1", "s2").alias("cls"), "n_set", "bits", "sketch"))


def _flat(batch, column: str) -> np.ndarray:
    """The values of an array column, one after the other."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _offsets(batch, column: str) -> np.ndarray:
    """Where each row's values start in ``_flat``, and their end."""
    off = batch.column(column).offsets.to_numpy()
    return off - off[0]


def _maybe_shared(docs: DataFrame) -> DataFrame:
    """(cls, bucket) of the sketches that more than one chunk may have. Most sketches occur once; count-min sketches drop those."""
    rows = docs.agg(F.count(F.lit(1))).first()[0]

    def keys(b):
        cls = np.repeat(b.column("cls").to_numpy(zero_copy_only=False), np.diff(_offsets(b, "sketch")))
        return _flat(b, "sketch").view(V.U), cls, np.zeros(len(cls), np.int32)

    return maybe_repeated(docs.select("cls", "sketch"), keys, rows * SKETCHES).select(F.col("owner").alias("cls"), F.col("h").alias("bucket"))


def _pairs_in(ids: str) -> F.Column:
    return F.expr(f"flatten(transform({ids}, (x, i) -> transform(slice({ids}, i + 2, size({ids})), y -> struct(least(x, y) as a, greatest(x, y) as b))))")


def candidates(docs: DataFrame, chunks: DataFrame, k: int = K, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (a, b, na, nb) of classes that agree in a sketch and may reach the threshold, with the sizes of their sets.

    Buckets of up to ``crowd`` classes are paired as they are. Larger ones are split exactly: members
    are joined on the k-mers of their prefix, ordered by how rare they are within the bucket, which
    every pair at or above the threshold must share.
    """
    reps = _maybe_shared(docs).distinct()
    # counted before they are gathered: map-side combine takes a hot bucket apart
    sizes = reps.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(reps.join(sizes, "bucket"))
    small = shared.where(F.col("n") <= crowd).groupBy("bucket").agg(F.collect_list("cls").alias("ids"))
    pairs = small.select(F.explode(_pairs_in("ids")).alias("p")).select("p.a", "p.b")
    hot = shared.where(F.col("n") > crowd).select("bucket", "cls")
    if not hot.isEmpty():
        pairs = pairs.union(prefix_pairs(hot, _kmer_sets(hot.select("cls").distinct(), docs, chunks, k), threshold))
    return within_reach(pairs.where("a <> b").distinct(), docs, threshold)


def within_reach(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs, as (a, b, na, nb) with the sizes of their sets, whose Jaccard similarity may reach the threshold, by the sizes and bits of their sets; loses none that does.

    Two k-mers with different bits differ, so a set has at least as many k-mers that the other lacks as it has bits
    that the other lacks; what both have is at most the rest.
    """
    sets = materialize(docs.select("cls", "n_set", "bits").dropDuplicates(["cls"]))
    a, b = (sets.select(F.col("cls").alias(s), F.col("n_set").alias(f"n{s}"), F.col("bits").alias(f"b{s}")) for s in "ab")
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    both = F.least(F.col("na") - lacks("ba", "bb"), F.col("nb") - lacks("bb", "ba"))
    return pairs.join(a, "a").join(b, "b").where(both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b", "na", "nb")


def _texts_of(ids: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(cls, text) of one chunk for each class in ``ids`` (cls).

    A sketch of the wanted cids, which may let through too much but never too little, keeps most other texts out of
    the shuffle of the join; where it would be too large, the join does without.
    """
    one = materialize(docs.join(ids, "cls", "left_semi").groupBy("cls").agg(F.min("cid").alias("cid")))
    some = chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", "text")
    cells = cells_for(one.count(), 4)
    if cells:
        hashed = lambda b: b.column("x").to_numpy(zero_copy_only=False).view(V.U)
        wanted = docs.sparkSession.sparkContext.broadcast(merged_counts(one.select(F.xxhash64("cid").alias("x")), hashed, cells))

        def keep(batches):
            for b in batches:
                yield b.filter(pa.array(wanted.value.counted(hashed(b)))).select(["cid", "text"])

        some = some.select("cid", "text", F.xxhash64("cid").alias("x")).mapInArrow(keep, "cid string, text string")
    return some.join(one, "cid").dropDuplicates(["cid"]).select("cls", "text")


def _kmer_sets(ids: DataFrame, docs: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(cls, h) for every distinct k-mer of the classes in ``ids``."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in V.blocks(texts):
                h, doc = V.shingles(*V.words(texts[i:j]), k)
                yield pd.DataFrame({"cls": pdf["cls"].to_numpy()[i:j][doc], "h": h.view(np.int64)}).drop_duplicates()

    return _texts_of(ids, docs, chunks).mapInPandas(run, "cls long, h long")


def prefix_pairs(members: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket that share a k-mer of both prefixes (exact for the threshold)."""
    rows = members.join(kmers, "cls")
    df = rows.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("df"))
    own = W.partitionBy("bucket", "cls")
    ranked = rows.join(df, ["bucket", "h"]).select(
        "bucket", "cls", "h", "df", F.row_number().over(own.orderBy("df", "h")).alias("r"), F.count(F.lit(1)).over(own).alias("n")
    )
    lead = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1)).select("bucket", "h", "cls")
    a, b = lead.select("bucket", "h", F.col("cls").alias("a")), lead.select("bucket", "h", F.col("cls").alias("b"))
    return a.join(b, ["bucket", "h"]).where("a < b").select("a", "b").distinct()


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without their common start and end, which an optimal alignment may match."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    s = n if same.all() else int(same.argmin())
    x, y, n = x[s:], y[s:], n - s
    same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
    e = n if same.all() else int(same.argmin())
    return x[: len(x) - e], y[: len(y) - e]


def edit_similarity(a: list[np.ndarray], b: list[np.ndarray], band: int = 16) -> np.ndarray:
    """1 - distance / longer length of each pair of word sequences, by alignment within a diagonal band.

    Besides the diagonals between the two corners, the band has ``band`` more to both sides. Where the
    best alignment leaves it (a block was moved far), the similarity is a lower bound.
    """
    longest = np.maximum(1, np.array([max(len(x), len(y)) for x, y in zip(a, b)]))
    cut = [_trimmed(*((x, y) if len(x) <= len(y) else (y, x))) for x, y in zip(a, b)]
    na = np.array([len(x) for x, _ in cut])
    extra = np.array([len(y) for _, y in cut]) - na  # >= 0: the second is the longer
    dist = np.where(na == 0, extra, 0).astype(np.int64)
    todo = np.flatnonzero(na > 0)
    todo = todo[np.lexsort((extra[todo], (na[todo] + 15) // 16))]
    far = np.int32(1 << 28)
    for s in range(0, len(todo), 128):
        part = todo[s : s + 128]
        rows, width = int(na[part].max()), int(extra[part].max()) + 2 * band + 1
        pa = np.full((rows, len(part)), -1, np.int32)
        pb = np.full((rows + width + band, len(part)), -2, np.int32)
        for i, p in enumerate(part):
            x, y = cut[p]
            pa[: len(x), i] = x
            pb[band : band + len(y), i] = y
        nb = (na + extra)[part]
        diag = np.arange(width, dtype=np.int32)[:, None]
        col = diag - band
        d = np.where((col >= 0) & (col <= nb), col, far).astype(np.int32)
        for i in range(rows):
            col = diag - band + (i + 1)
            new = d + (pb[i : i + width] != pa[i])
            np.minimum(new[:-1], d[1:] + 1, out=new[:-1])
            edge = band - i - 1  # where the column is 0
            if edge >= 0:
                new[:edge] = far
                new[edge] = i + 1
            new = np.minimum.accumulate(new - diag, axis=0) + diag
            if edge > 0:
                new[:edge] = far
            d = new
            done = np.flatnonzero(na[part] == i + 1)
            if len(done):
                dist[part[done]] = d[extra[part[done]] + band, done]
    return 1 - dist / longest


def proven(na: np.ndarray, nb: np.ndarray, edits: np.ndarray, k: int) -> np.ndarray:
    """The least Jaccard similarity of two k-mer sets of these sizes, whose texts are so many edits of words apart."""
    both = np.maximum(0, np.maximum(na, nb) - k * edits)
    return both / np.maximum(1, na + nb - both)


def verify(pairs: DataFrame, docs: DataFrame, chunks: DataFrame, k: int = K, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(a, b, jaccard, edit_similarity) of those of the pairs (a, b, na, nb) that reach the threshold, over their whole texts.

    Where the alignment proves that a pair does, ``jaccard`` is null, unless ``exact`` asks for it.
    """

    def tokens(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in V.blocks(texts):
                w, at = V.words(texts[i:j])
                # 32 bits are enough to tell the words of two texts apart
                if i == j:
                    continue
                yield pd.DataFrame({"cls": pdf["cls"].to_numpy()[i:j], "w": np.split((w >> V.U(32)).astype(np.uint32).view(np.int32), at[1:-1])})

    def compare(batches):
        for b in batches:
            words, ats = zip(*((_flat(b, c), _offsets(b, c).astype(np.int64)) for c in ("wa", "wb")))
            longest = np.maximum(1, np.maximum(*(np.diff(at) for at in ats)))
            edit = edit_similarity(*([w[i:j] for i, j in zip(at[:-1], at[1:])] for w, at in zip(words, ats)))
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            sure = proven(na, nb, np.rint((1 - edit) * longest).astype(np.int64), k) >= threshold
            jaccard = np.full(b.num_rows, np.nan)
            rest = np.arange(b.num_rows) if exact else np.flatnonzero(~sure)
            sets = []
            for w, at in zip(words, ats):
                some = np.repeat(np.isin(np.arange(b.num_rows), rest), np.diff(at))
                starts = np.r_[0, np.cumsum(np.diff(at)[rest])]
                h, doc = V.shingles(V.mix(w[some].view(np.uint32).astype(V.U) + V.U(1)), starts, k)
                sets.append(_distinct(doc, h))
            doc, h = (np.concatenate(x) for x in zip(*sets))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            both = np.bincount(doc[1:][same], minlength=len(rest))
            jaccard[rest] = both / np.maximum(1, na[rest] + nb[rest] - both)
            ok = np.flatnonzero(sure | (jaccard >= threshold))
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok)), pa.array(jaccard[ok], from_pandas=True), pa.array(edit[ok])], ["a", "b", "jaccard", "edit_similarity"])

    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    words = materialize(_texts_of(ids, docs, chunks).mapInPandas(tokens, "cls long, w array<int>"))
    both = pairs.join(words.select(F.col("cls").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("cls").alias("b"), F.col("w").alias("wb")), "b")
    return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(compare, "a long, b long, jaccard double, edit_similarity double")


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (doc, h) once; ``doc`` ascends."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])] if len(d) else np.empty(0, bool)
    return d[new], x[new]


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, k: int = K, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, docs): verified links between classes, and the membership of every chunk.

    links: (a, b, jaccard, edit_similarity) with a < b, Jaccard at or above ``threshold`` (null where the alignment
    proves that, unless ``exact``); classes of
    one canonical key are linked too if their k-mer sets differ. docs: (cid, key, cls, n_set, bits, sketch).
    Null cids or texts and texts of fewer than k words have no links. Repeated rows of a cid count once.
    """
    docs = sketch_table(chunks, k)
    pairs = materialize(candidates(docs, chunks, k, threshold))
    links = materialize(verify(pairs, docs, chunks, k, threshold, exact))
    return links, docs


def _expanded(links: DataFrame, members: DataFrame, part: int | None = None) -> DataFrame:
    """(x, kx, y, ky): every member of class a with every member of class b, for each link (a, b).

    Classes of more than ``part`` members are cut into parts by hash and each part of the one side meets
    each of the other, so that no task has a huge class whole. No pair is left out.
    """
    part = PART if part is None else part
    big = materialize(members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).where("parts > 1"))
    cut = not big.isEmpty()
    if cut:
        members = members.join(big, "cls", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("cid"), "parts"), F.lit(0)))
    got = links.select("a", "b")
    for side, cid, key in (("a", "x", "kx"), ("b", "y", "ky")):
        rows = members.withColumnsRenamed({"cls": side, "cid": cid, "key": key, "part": f"p{side}"}).drop("parts")
        if cut:
            got = got.join(big.withColumnRenamed("cls", side), side, "left").withColumn(f"p{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        got = got.join(rows, [side, f"p{side}"] if cut else [side])
    return got.select("x", "kx", "y", "ky")


def found(chunks: DataFrame) -> DataFrame:
    """p1_found: (cid_a, cid_b) of all linked chunks that are not the same record, every chunk of every class."""
    links, docs = near_duplicates(chunks)
    linked = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).distinct()
    # few rows, used on both sides: written once, so that the docs aren't shuffled again for each use
    members = materialize(docs.select("cls", "cid", "key").join(linked, "cls", "left_semi").distinct())
    got = _expanded(links, members).where("kx <> ky and x <> y")
    return got.select(F.least("x", "y").alias("cid_a"), F.greatest("x", "y").alias("cid_b"))


def representatives(chunks: DataFrame) -> DataFrame:
    """(cid_a, cid_b, jaccard, edit_similarity): links between classes, each by its smallest cid, with what the alignment says.

    A class is all chunks of one canonical key and one set of k-mers, so it stands for texts that differ in layout only;
    ``groups`` has the class and the representative of every chunk. ``edit_similarity`` counts words in order: it is far
    below ``jaccard`` where blocks were moved.
    """
    links, docs = near_duplicates(chunks, exact=True)
    first = docs.groupBy("cls").agg(F.min("cid").alias("cid"), F.min("key").alias("key"))
    a, b = (first.withColumnsRenamed({"cls": s, "cid": f"x{s}", "key": f"k{s}"}) for s in "ab")
    rows = links.join(a, "a").join(b, "b").where("ka <> kb")
    return rows.select(F.least("xa", "xb").alias("cid_a"), F.greatest("xa", "xb").alias("cid_b"), F.round("jaccard", 6).alias("jaccard"), F.round("edit_similarity", 6).alias("edit_similarity"))


def groups(chunks: DataFrame) -> DataFrame:
    """(cid, path, class_cid, group_cid, group_classes, links): one row for each (cid, path).

    ``class_cid`` is the smallest cid of the chunk's class. A group is a connected component of links and of copies of
    one record; ``group_cid`` is its smallest cid, ``group_classes`` the number of its classes, ``links`` the number of
    classes of other records that the chunk's class is linked to. Chunks without links or copies are groups of
    their own. A text of fewer than three words has no k-mers: its class is its canonical key. Null cids and texts have no row.
    """
    links, docs = near_duplicates(chunks)
    usable = chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", "text")

    def short(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            few = [i for i, t in enumerate(texts) if len(V.words([t])[0]) < K] if texts else []
            key = canonical_hashes([texts[i] for i in few]) if few else np.empty(0, V.U)
            yield pd.DataFrame({"cid": pdf["cid"].iloc[few].tolist(), "key": key.view(np.int64), "cls": V.mix(key).view(np.int64)})

    # what has few letters can have few words only; the rest isn't looked at again
    brief = usable.where(F.size(F.split("text", r"[^\p{L}\p{N}_]+", 6)) <= K + 2).mapInPandas(short, "cid string, key long, cls long")
    members = materialize(docs.select("cid", "key", "cls").unionByName(brief).distinct())
    # copies of one record belong together whatever their k-mers: chain every class to the record's smallest
    same = members.groupBy("key").agg(F.min("cls").alias("a")).join(members.select("key", F.col("cls").alias("b")).distinct(), "key").where("a <> b").select("a", "b")
    comp = components(links.select("a", "b").union(same))
    records = members.groupBy("cls").agg(F.min("key").alias("key"), F.min("cid").alias("class_cid"))
    both = links.select("a", "b").union(links.select("b", "a"))
    of = lambda s: records.select(F.col("cls").alias(s), F.col("key").alias(f"k{s}"))
    degree = both.join(of("a"), "a").join(of("b"), "b").where("ka <> kb").groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("links"))
    per_class = materialize(records.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    whole = per_class.groupBy("component").agg(F.min("class_cid").alias("group_cid"), F.count(F.lit(1)).alias("group_classes"))
    per_class = per_class.join(whole, "component").join(degree, "cls", "left")
    paths = chunks.where(F.col("cid").isNotNull()).select("cid", "path").distinct()
    rows = members.select("cid", "cls").distinct().join(per_class, "cls").join(paths, "cid")
    return rows.select("cid", "path", "class_cid", "group_cid", "group_classes", F.coalesce("links", F.lit(0)).alias("links"))


def recall(chunks: DataFrame, every: int = 100) -> DataFrame:
    """(n_queries, n_true, n_found): links of the classes of every chunk whose hashed cid is divisible by ``every``.

    ``n_true`` are those of an exact search: two sets of k-mers at or above the threshold share one of the rarest of either
    set, as many as the threshold leaves, so a query's rarest k-mers are joined with those of all chunks and what
    that finds is verified. ``n_found`` are those of them that the operator finds too. Classes of one record don't count.
    """
    docs = sketch_table(chunks)
    of_other = lambda p: p.join(keyed("a"), "a").join(keyed("b"), "b").where("ka <> kb").select("a", "b")
    keyed = lambda s: docs.groupBy(F.col("cls").alias(s)).agg(F.min("key").alias(f"k{s}"))
    pairs = of_other(verify(materialize(candidates(docs, chunks)), docs, chunks))
    asked = materialize(docs.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).select("cls").distinct())
    sets = materialize(_kmer_sets(docs.select("cls").distinct(), docs, chunks, K))
    df = sets.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    own = W.partitionBy("cls")
    ranked = sets.join(asked, "cls").join(df, "h").select("cls", "h", F.row_number().over(own.orderBy("df", "h")).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    rare = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * THRESHOLD) + 1).select(F.col("cls").alias("x"), "h")
    near = rare.join(sets.select(F.col("cls").alias("y"), "h"), "h").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    size = lambda s: docs.select(F.col("cls").alias(s), F.col("n_set").alias(f"n{s}")).dropDuplicates([s])
    near = near.join(size("a"), "a").join(size("b"), "b")  # without the bits and the alignment, so that they are tested too
    true = of_other(verify(materialize(near), docs, chunks, exact=True).where(F.col("jaccard") >= THRESHOLD))
    got = true.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).join(got, how="cross")  # one row each
