"""Batches of questions over a stored index, in blocks of questions against parts of the index.

Equal questions are searched once. Each part (some buckets) is written once as arrays: its vectors, and the places and
frequencies of the phrases that are asked. A task then takes a block of questions through all parts and keeps the best of each
channel, so no pair of a question and a chunk is ever shuffled or written. What it computes is what ``plans.recall``
computes: exact nearest vectors, BM25 with the tenant's frequencies, fusion, decay, diversity.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..functions.text import snippet
from ..local import phrases, shown, word_list
from ..operators import fusion, vectors
from ..operators.keyword import B, IDF_FLOOR, K1
from ..session import materialize
from .index import Snapshot, part_files

#: Buckets of a part at most; parts that a small index has if it can; questions of a block; sizes of a product of matrices.
BUCKETS, PARTS, BLOCK, ROWS, SLICE = 8, 8, 2048, 256, 8192
#: Relative error of a float of 32 bits. Scores are compared to nine digits, distances to twelve.
EPS, TIE = 1.2e-7, 2e-9

_FIELDS = ("vec", "has_vec", "hi", "lo", "cid", "age", "mtime", "evergreen", "dl", "file", "row", "ptr", "doc", "tf")


def recall(snap: Snapshot, config: RecallConfig, queries: DataFrame, now: float) -> DataFrame:
    """(qid, pos, id, score, file, text, snippet): the hits of each of ``queries`` (qid, query, k) in order."""
    spark = snap.spark
    asked = queries.where("qid IS NOT NULL").select("qid", F.coalesce("query", F.lit("")).alias("query"), "k")
    questions = materialize(asked.select("query", "k").distinct().select(F.monotonically_increasing_id().alias("n"), "query", "k"))
    folder = os.path.join(snap.store.root, f"batch-{uuid.uuid4().hex}")
    try:
        hits = materialize(_searched(snap, config, questions, folder, now))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    chunks = snap.chunks.select(F.col("cid").alias("id"), F.col("path").alias("file"), "text")
    whole = hits.join(chunks, "id").select("n", F.struct("pos", "id", "score", "file", "text", snippet(F.col("text"), config.snippet_chars).alias("snippet")).alias("h"))
    answers = whole.groupBy("n").agg(F.collect_list("h").alias("hits")).join(questions, "n").select("query", "k", "hits")
    return asked.join(answers, ["query", "k"]).select("qid", F.inline("hits"))


def _searched(snap: Snapshot, config: RecallConfig, questions: DataFrame, folder: str, now: float) -> DataFrame:
    """(n, pos, id, score) of ``questions`` (n, query, k). ``folder`` is where the parts are written."""
    spark, meta = snap.spark, snap.meta
    n, dim, model = questions.count(), config.dim, config.model
    at = dict(meta["tables"]["chunks"]) if meta else {}
    none = spark.createDataFrame([], "n long, pos int, id string, score double")
    if not n or not at:
        return none
    os.makedirs(folder)

    def asked(batches):
        for pdf in batches:
            yield pd.DataFrame({"phrase": sorted({p for q in pdf["query"] for p in phrases(q)})}, dtype=object)

    questions.mapInPandas(asked, "phrase string").distinct().write.parquet(f"file://{folder}/phrases")
    size = min(BUCKETS, -(-len(at) // PARTS))
    place = {b: i // size for i, b in enumerate(sorted(map(int, at)))}
    files = {name: {place[int(b)]: [] for b in at} for name in ("chunks", "occurrences")}
    for name, of in files.items():
        for b, (where, _) in sorted(meta["tables"][name].items()):
            if int(b) in place:
                of[place[int(b)]] += part_files(os.path.join(snap.store.root, where))
    bucket = F.pmod(F.xxhash64("path"), F.lit(meta["buckets"])).cast("int")
    part = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), bucket).alias("part")
    have = snap.cache.where(F.col("model") == model).select("hash", "vec").dropDuplicates(["hash"])
    vecs = snap.chunks.select(part, "cid", "hash").join(have, "hash", "left").select("part", "cid", "vec")

    def build(key, pdf):
        _build(folder, int(key[0]), files["chunks"][int(key[0])], files["occurrences"][int(key[0])], pdf, dim)
        return pd.DataFrame({"part": [int(key[0])]})

    parts = sorted(r["part"] for r in vecs.groupBy("part").applyInPandas(build, "part int").collect())  # a row a part
    if not parts:
        return none

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                yield _search(folder, parts, pdf[a : a + BLOCK], config, now)

    blocks = max(-(-n // BLOCK), min(-(-n // 32), 2 * spark.sparkContext.defaultParallelism))
    return questions.repartition(blocks).mapInPandas(run, "n long, pos int, id string, score double")


def _vocabulary(folder: str) -> tuple[list[str], list[str]]:
    """The asked phrases: those of one token, then the others, each in order."""
    found = [p for f in part_files(os.path.join(folder, "phrases")) for p in pq.ParquetFile(f).read()["phrase"].to_pylist()]
    return sorted(p for p in found if " " not in p), sorted(p for p in found if " " in p)


def _build(folder: str, part: int, chunk_files: list[str], occ_files: list[str], vecs: pd.DataFrame, dim: int) -> None:
    """Write a part: its chunks in order of cid, their vectors, and the places of the asked phrases."""
    columns = ["cid", "age_days", "evergreen", "mtime", "dl"]
    chunks = pd.concat([pq.ParquetFile(f).read(columns=columns).to_pandas().assign(file=i, row=lambda t: np.arange(len(t))) for i, f in enumerate(chunk_files)])
    chunks = chunks.sort_values("cid", ignore_index=True)  # ties go by cid, so by place
    cid = chunks["cid"].to_numpy().astype("S64")
    vecs = vecs[vecs["vec"].notna()]
    has = np.searchsorted(cid, vecs["cid"].to_numpy().astype("S64"))
    order = np.argsort(has)
    singles, longer = _vocabulary(folder)
    tokens = [*singles, *sorted({t for p in longer for t in p.split(" ")} - set(singles))]
    code, doc, pos = [], [], []
    for f in occ_files:  # one after the other, as their tokens are all in memory
        t = pq.ParquetFile(f).read(columns=["cid", "terms"]).combine_chunks()
        if not len(t):
            continue
        terms = t["terms"].combine_chunks() if isinstance(t["terms"], pa.ChunkedArray) else t["terms"]
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
        asked = pc.fill_null(pc.index_in(terms.flatten(), value_set=pa.array(tokens, pa.string())), -1).to_numpy()
        mine = np.flatnonzero(asked >= 0)
        code.append(asked[mine])
        doc.append(np.repeat(np.searchsorted(cid, t["cid"].to_numpy(zero_copy_only=False).astype("S64")), n)[mine])
        pos.append((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[mine])
    code, doc, pos = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (code, doc, pos))
    by = np.lexsort((pos, doc, code))
    code, doc, pos = code[by], doc[by], pos[by]
    start = np.searchsorted(code, np.arange(len(tokens) + 1))
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.empty(0, np.int64)
    tf = np.diff(np.r_[first, len(code)])
    end = np.searchsorted(code[first], len(singles))
    docs, tfs, ptr = [doc[first][:end]], [tf[:end]], [np.searchsorted(code[first], np.arange(len(singles) + 1))]
    place = {t: i for i, t in enumerate(tokens)}
    for p in longer:
        here = None
        for i, t in enumerate(p.split(" ")):
            a, b = start[place[t]], start[place[t] + 1]
            at = doc[a:b] * (1 << 32) + pos[a:b] - i
            here = at if here is None else np.intersect1d(here, at, assume_unique=True)
        d, n = np.unique(here >> 32, return_counts=True)
        docs.append(d)
        tfs.append(n)
        ptr.append(ptr[-1][-1:] + len(d))
    docs, tfs = np.concatenate(docs), np.concatenate(tfs)
    small = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.int32)
    halves = [np.array([int(c[a : a + 16] or b"0", 16) for c in cid.tolist()], np.uint64) for a in (0, 16)]
    data = {
        "vec": np.stack(vecs["vec"].to_numpy()[order]).astype(np.float32) if len(order) else np.zeros((0, dim), np.float32), "has_vec": has[order], "hi": halves[0], "lo": halves[1], "cid": cid,
        "age": chunks["age_days"].to_numpy(float), "mtime": chunks["mtime"].to_numpy(float), "evergreen": chunks["evergreen"].fillna(False).to_numpy(bool), "dl": chunks["dl"].to_numpy(float),
        "file": chunks["file"].to_numpy(np.int32), "row": chunks["row"].to_numpy(np.int32), "ptr": np.concatenate(ptr), "doc": small(docs), "tf": small(tfs),
    }
    made = os.path.join(folder, f"{part}-{uuid.uuid4().hex}")  # a task that runs again makes its own
    os.makedirs(made)
    for name in _FIELDS:
        np.save(os.path.join(made, name + ".npy"), data[name])
    with open(os.path.join(made, "files.json"), "w") as f:
        json.dump(chunk_files, f)
    with open(os.path.join(made, "done"), "w") as f:
        f.write(made)
    os.replace(os.path.join(made, "done"), os.path.join(folder, f"part-{part}"))


class _Part:
    def __init__(self, folder: str, part: int):
        with open(os.path.join(folder, f"part-{part}")) as f:
            at = f.read()
        for name in _FIELDS:
            setattr(self, name, np.load(os.path.join(at, name + ".npy"), mmap_mode="r"))
        with open(os.path.join(at, "files.json")) as f:
            self.files = json.load(f)


def _best(found: list[tuple], most: int) -> tuple:
    """Of (question, key, hi, lo, part, place) arrays the ``most`` rows of each question with the least keys, then cids, in order."""
    a = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((a[3], a[2], a[1], a[0]))
    q = a[0][order]
    keep = order[np.arange(len(q)) - np.searchsorted(q, q) < most]
    return tuple(x[keep] for x in a)


def _nothing() -> tuple:
    return (*(np.empty(0, t) for t in (np.int64, np.float64, np.uint64, np.uint64, np.int64, np.int64)),)


def _last(best: tuple, n: int, most: int) -> np.ndarray:
    """The key of each question's last row if it has ``most`` rows, else infinity."""
    ends = np.searchsorted(best[0], np.arange(n + 1))
    out = np.full(n, np.inf)
    full = np.flatnonzero(np.diff(ends) >= most)
    out[full] = best[1][ends[full + 1] - 1]
    return out


def _near(p: _Part, part: int, asked: np.ndarray, last: np.ndarray, most: int) -> list[tuple]:
    """Rows of ``_best`` with the vectors of a part that may be among the ``most`` nearest; ``last`` is the distance to beat.

    Products of 32 bits choose them, with room for their error; distances are then taken in 64 bits.
    """
    x, found = np.asarray(p.vec), []
    if not len(x):
        return found
    sq = (x.astype(float) ** 2).sum(1)
    norm, longest = np.sqrt((asked * asked).sum(1)), math.sqrt(sq.max())
    room = EPS * (2 * (x.shape[1] + 4) * norm * longest + 4 * longest * longest) + 1e-12
    limit = last**2 - norm**2 + room + 1e-9
    sq32 = sq.astype(np.float32)
    for a in range(0, len(asked), ROWS):
        y = asked[a : a + ROWS]
        y32, cut = (-2 * y).astype(np.float32), limit[a : a + ROWS]
        for b in range(0, len(x), SLICE):
            near = y32 @ x[b : b + SLICE].T
            near += sq32[None, b : b + SLICE]
            if near.shape[1] > most and np.isinf(cut).any():
                cut = np.minimum(cut, np.partition(near, most - 1, axis=1)[:, most - 1] + 2 * room[a : a + ROWS])
            r, c = np.nonzero(near <= cut[:, None])
            if not len(r):
                continue
            d = np.empty(len(r))
            for s in range(0, len(r), 1 << 16):
                e = x[b + c[s : s + (1 << 16)]].astype(float) - y[r[s : s + (1 << 16)]]
                d[s : s + (1 << 16)] = np.sqrt((e * e).sum(1))
            at = p.has_vec[b + c]
            found.append(_best([(a + r, np.round(d, 12), p.hi[at], p.lo[at], np.full(len(r), part), at)], most))
    return found


def _scored(p: _Part, part: int, asked: list[dict[int, int]], idf: dict[int, float], avgdl: float, last: np.ndarray, most: int) -> list[tuple]:
    """Rows of ``_best`` with the chunks of a part that may be among the ``most`` best by BM25; keys are negative scores."""
    norm = K1 * (1 - B + B * np.asarray(p.dl) / avgdl) if avgdl else np.zeros(len(p.dl))
    weights = {}
    for t, v in idf.items():
        a, b = int(p.ptr[t]), int(p.ptr[t + 1])
        if b > a:
            doc, tf = np.asarray(p.doc[a:b]), np.asarray(p.tf[a:b]).astype(float)
            weights[t] = doc, v * (tf * (K1 + 1)) / (tf + norm[doc])
    q, key, at = [], [], []
    for i, terms in enumerate(asked):
        score, any_ = None, False
        for t, times in terms.items():
            if t in weights:
                score = np.zeros(len(p.dl)) if score is None else score
                doc, w = weights[t]
                score[doc] += w * times
                any_ = True
        if not any_:
            continue
        c = np.flatnonzero(score >= -last[i] - TIE) if np.isfinite(last[i]) and -last[i] > TIE else np.flatnonzero(score > 0)
        s = score[c]
        if len(c) > 4 * most:
            enough = s >= np.partition(s, len(s) - most)[len(s) - most] - TIE
            c, s = c[enough], s[enough]
        s = -np.round(s, 9)
        first = np.lexsort((c, s))[:most]
        q.append(np.full(len(first), i))
        key.append(s[first])
        at.append(c[first])
    if not q:
        return []
    q, key, at = map(np.concatenate, (q, key, at))
    return [(q, key, p.hi[at], p.lo[at], np.full(len(q), part), at)]


def _search(folder: str, parts: list[int], asked: pd.DataFrame, config: RecallConfig, now: float) -> pd.DataFrame:
    """(n, pos, id, score): the hits of a block of questions (n, query, k)."""
    queries, ks = asked["query"].tolist(), asked["k"].tolist()
    n, held = len(queries), {i: _Part(folder, i) for i in parts}
    number = {p: i for i, p in enumerate(w for group in _vocabulary(folder) for w in group)}
    terms = [{number[p]: times for p, times in phrases(q).items()} for q in queries]
    used = np.array(sorted({t for x in terms for t in x}), int)
    df = sum(p.ptr[used + 1] - p.ptr[used] for p in held.values())
    n_docs = sum(len(p.dl) for p in held.values())
    avgdl = sum(p.dl.sum() for p in held.values()) / n_docs
    idf = {int(t): raw if (raw := math.log((n_docs - d + 0.5) / (d + 0.5))) > 0 else IDF_FLOOR for t, d in zip(used, df.tolist())}
    vecs = np.asarray(vectors.embedder(config.model, config.dim)(queries), float)
    near, best = _nothing(), _nothing()
    for i, p in held.items():
        near = _best([near, *_near(p, i, vecs, _last(near, n, config.vec_pool), config.vec_pool)], config.vec_pool)
        best = _best([best, *_scored(p, i, terms, idf, avgdl, _last(best, n, config.fts_pool), config.fts_pool)], config.fts_pool)
    ranks: list[dict] = [{} for _ in range(n)]
    for channel, rows in enumerate((near, best)):
        place = np.arange(len(rows[0])) - np.searchsorted(rows[0], rows[0])
        for q, part, at, r in zip(*(x.tolist() for x in (rows[0], rows[4], rows[5], place))):
            ranks[q].setdefault((part, at), [None, None])[channel] = r
    chosen = []
    for q, k in enumerate(ks):
        scored = []
        for (part, at), pair in ranks[q].items():
            score, p = sum(1.0 / (config.rrf_k + r) for r in pair if r is not None), held[part]
            if config.half_life_days > 0:
                age = max(0.0, (now - float(p.mtime[at])) / 86400.0) if config.live_age else float(p.age[at])
                if not (p.evergreen[at] or math.isnan(age)):
                    score *= math.exp(-math.log(2.0) / config.half_life_days * age)
                score = round(score, 12)
            if config.min_score is None or score >= config.min_score:
                scored.append((-score, *(math.inf if r is None else r for r in pair), part, at))
        chosen.append(sorted(scored)[: fusion.candidates_needed(k)])
    codes = _words(held, {x[3:] for best in chosen for x in best}) if config.mmr_lambda < 1.0 else {}
    out = []
    for number_, k, rows in zip(asked["n"].tolist(), ks, chosen):
        order = fusion.mmr_select([codes[x[3:]].tolist() for x in rows], k, config.mmr_lambda) if config.mmr_lambda < 1.0 else range(min(k, len(rows)))
        for pos, c in enumerate(order):
            x = rows[c]
            out.append((number_, pos, held[x[3]].cid[x[4]].decode(), shown(-x[0])))
    return pd.DataFrame(out, columns=["n", "pos", "id", "score"])


def _words(held: dict[int, _Part], wanted: set) -> dict:
    """The different words of chunks (part, place) as numbers; files are read one at a time."""
    by: dict = {}
    for part, at in wanted:
        by.setdefault((part, int(held[part].file[at])), []).append(at)
    number: dict[str, int] = {}
    out = {}
    for (part, file), places in by.items():
        texts = pq.ParquetFile(held[part].files[file]).read(columns=["text"])["text"].take(pa.array(held[part].row[places])).to_pylist()
        for at, text in zip(places, texts):
            out[part, at] = np.array([number.setdefault(w, len(number)) for w in set(word_list(text))], np.int32)
    return out
