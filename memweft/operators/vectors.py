"""Vector channel: embedders and exact nearest neighbours in blocks."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword import top

#: Rows of a block of vectors that one task compares with a block of queries.
BLOCK, QUERIES = 8192, 4096

_WORD = re.compile(r"\w+")


@lru_cache(maxsize=1 << 17)
def _slot(word: str, dim: int) -> tuple[int, int]:
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 == 0 else -1


class HashEmbedder:
    """Deterministic embedding without a model: words are hashed to signed slots and counted.

    Texts that share words are near; meaning beyond words is not seen. Vectors are not normalised here;
    ``embed`` does that. Serves as the default, for tests, and as a template for real models.
    """

    def __init__(self, dim: int):
        self.dim = dim

    def counts(self, texts) -> np.ndarray:
        """Signed counts of each text's slots; a word is hashed once however often a batch has it."""
        found = [_WORD.findall((t or "").lower()) for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        code, words = pd.factorize(np.array(list(chain.from_iterable(found)), object))
        slot = np.array([_slot(w, self.dim) for w in words], np.int64).reshape(-1, 2)[code]
        at = np.repeat(np.arange(len(found)), n) * self.dim + slot[:, 0]
        return np.bincount(at, slot[:, 1], len(found) * self.dim).astype(np.int32).reshape(len(found), self.dim)

    def __call__(self, texts) -> np.ndarray:
        c = self.counts(texts).astype(np.float64)
        n = np.sqrt((c * c).sum(1, keepdims=True))
        return (c / np.where(n > 0, n, 1)).astype(np.float32)


_models: dict[tuple[str, int], object] = {}


def embedder(model: str, dim: int):
    """The embedder of a model name, one of each per process.

    ``signed-hash-<n>`` is built in; other names are loaded through an optional package if it is installed.
    """
    key = (model, dim)
    if key not in _models:
        if model.startswith("signed-hash"):
            tail = model.rpartition("-")[2]
            _models[key] = HashEmbedder(int(tail) if tail.isdigit() else dim)
        else:
            try:
                from fastembed import TextEmbedding
            except ImportError as e:
                raise RuntimeError(f"no embedder for model {model!r}: its package isn't installed") from e
            loaded = TextEmbedding(model_name=model)
            _models[key] = lambda texts: np.array([list(v) for v in loaded.embed(list(texts))], np.float32)
    return _models[key]


def embed(text: Column, model: str, dim: int) -> Column:
    """Arrow UDF: the vector of each text by ``model``; a null text is embedded as the empty one."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(model, dim)(["" if t is None else t for t in texts])))

    return run(text)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays in double precision, as an expression."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def nearest(base: DataFrame, queries: DataFrame, group: str, k: int) -> DataFrame:
    """(group, qid, id, dist, rank): the k nearest of ``base`` (group, id, vec) for ``queries`` (group, qid, vec).

    Exact. Both sides are cut into blocks within their group, and each task compares one block of
    vectors with one block of queries by matrix product in double precision; only its k best for each
    query leave it. Equal distances are in order of id. A query is compared with vectors of its own length;
    rows with a null group, id or vector are left out.
    """
    base = base.where(F.col(group).isNotNull() & F.col("id").isNotNull() & F.col("vec").isNotNull())
    queries = queries.where(F.col(group).isNotNull() & F.col("qid").isNotNull() & F.col("vec").isNotNull())
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("_nb")).join(queries.groupBy(group).agg(F.count(F.lit(1)).alias("_nq")), group)
    cuts = sizes.select(group, F.ceil(F.col("_nb") / BLOCK).cast("int").alias("_bb"), F.ceil(F.col("_nq") / QUERIES).cast("int").alias("_qb"))
    id_type, q_type = base.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    g_type = base.schema[group].dataType.simpleString()
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # all columns are named anew, as both sides may come from one table
    left = base.join(cuts, group).select(F.col(group).alias("_g"), own("id", "_bb").alias("_b"), each("_qb").alias("_q"), F.col("id").alias("_id"), F.col("vec").alias("_vec"))
    right = queries.join(cuts, group).select(F.col(group).alias("_h"), each("_bb").alias("_c"), own("qid", "_qb").alias("_r"), F.col("qid").alias("_qid"), F.col("vec").alias("_asked"))

    # the two sides come apart, so that no id passes through a column with nulls, where pandas would make it a double
    def run(key, b, q):
        out = [pd.DataFrame({group: [], "qid": [], "id": [], "dist": []})]
        b = b.sort_values("_id")
        blen, qlen = b["_vec"].map(len).to_numpy(int), q["_asked"].map(len).to_numpy(int)
        for dim in np.intersect1d(blen, qlen):
            ids, qids = b["_id"].to_numpy()[blen == dim], q["_qid"].to_numpy()[qlen == dim]
            x, y = (np.stack(v.to_numpy()[n == dim]).astype(float) for v, n in ((b["_vec"], blen), (q["_asked"], qlen)))
            sq, most = (x * x).sum(1), min(k, len(x))
            for s in range(0, len(y), 256):
                part = y[s : s + 256]
                near = sq[None, :] - 2 * part @ x.T
                # a few more than k, so that rounding in the product can't push out an equal one
                some = min(len(x), most + 16)
                at = np.argpartition(near, some - 1, axis=1)[:, :some] if some < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
                at.sort(axis=1)
                d = np.sqrt(((x[at] - part[:, None, :]) ** 2).sum(2))
                order = np.argsort(d, axis=1, kind="stable")[:, :most]
                at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
                out.append(pd.DataFrame({group: key[0], "qid": np.repeat(qids[s : s + len(part)], most), "id": ids[at.ravel()], "dist": d.ravel()}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    found = left.groupBy("_g", "_b", "_q").cogroup(right.groupBy("_h", "_c", "_r")).applyInPandas(run, f"`{group}` {g_type}, qid {q_type}, id {id_type}, dist double")
    return top(found, k, [F.asc("dist"), F.asc("id")], [group, "qid"], "rank")
