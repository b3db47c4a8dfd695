"""A small index in driver memory: single questions without a distributed plan.

A question about a few thousand notes is answered in milliseconds where a plan over the cluster takes seconds to
schedule. Below ``MOST_BYTES`` of index files a snapshot is read once, kept while its version is current, and searched with the
same steps as ``plans.recall``: exact nearest vectors, BM25 over the stored occurrences, fusion, decay, diversity.
Larger indexes, and batches of any size, go through the distributed plan.
"""

from __future__ import annotations

import math
import os
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from .config import RecallConfig
from .functions.text import FOLD_FROM, FOLD_TO, MARKS, STOPWORDS
from .operators import fusion, vectors
from .operators.keyword import B, IDF_FLOOR, K1
from .plans.index import Snapshot

#: Bytes of index files up to which a snapshot is held in memory; they take about four times as much there.
MOST_BYTES = 64 << 20

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_DROP = str.maketrans("", "", MARKS)
# letters, digits and private use; words have ``_`` besides letters and digits
_PRIVATE = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)))
_TOKEN = re.compile(f"(?:[^\\W_]|[{_PRIVATE}])+")
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    """``functions.text.keyword_tokens`` of one text."""
    return _TOKEN.findall(text.translate(_DROP).lower().translate(_FOLD))


def terms(query: str | None) -> list[str]:
    """``functions.text.query_terms`` of one query."""
    raw = _WORD.findall((query or "").lower())
    return [t for t in raw if len(t) > 1 and t not in STOPWORDS] or raw


def phrases(query: str | None) -> dict[str, int]:
    """The phrases of one query, tokens apart by a space, and how often it has each."""
    found: dict[str, int] = {}
    for t in terms(query):
        p = " ".join(tokens(t))
        if p:
            found[p] = found.get(p, 0) + 1
    return found


def word_list(text: str) -> list[str]:
    """``functions.text.words`` of one text."""
    return _WORD.findall(text.lower())


def shown(score: float) -> float:
    """A score to five digits, halves up, as the distributed plan rounds it."""
    return float(Decimal(repr(score)).quantize(Decimal("0.00001"), ROUND_HALF_UP))


def index_bytes(snapshot: Snapshot) -> int:
    return sum(os.path.getsize(p) for name in ("chunks", "emb_cache", "occurrences") for p in snapshot.files(name))


class LocalIndex:
    def __init__(self, snapshot: Snapshot, config: RecallConfig):
        self.snapshot, self.model, self.dim = snapshot, config.model, config.dim
        read = lambda name, cols: pa.concat_tables([pq.ParquetFile(p).read(columns=cols) for p in snapshot.files(name)] or [pa.table({c: [] for c in cols})], promote_options="permissive")
        chunks = read("chunks", ["cid", "path", "hash", "text", "age_days", "evergreen", "mtime", "dl"]).to_pandas()
        chunks = chunks.sort_values("cid", ignore_index=True)  # ties go by cid, so by place
        self.cid, self.path, self.text = (chunks[c].to_numpy(object) for c in ("cid", "path", "text"))
        self.age, self.mtime, self.dl = (chunks[c].to_numpy(float) for c in ("age_days", "mtime", "dl"))
        self.evergreen = chunks["evergreen"].fillna(False).to_numpy(bool)
        cache = read("emb_cache", ["hash", "model", "vec"]).to_pandas()
        cache = cache[cache["model"] == config.model].drop_duplicates("hash").set_index("hash")["vec"]
        have = chunks["hash"].isin(cache.index).to_numpy()
        self.has_vec = np.flatnonzero(have)
        self.vec = np.stack(cache.loc[chunks["hash"][have]].to_numpy()).astype(float) if have.any() else np.zeros((0, config.dim))
        self.sq = (self.vec * self.vec).sum(1)
        occ = read("occurrences", ["cid", "terms"])
        n = occ["terms"].combine_chunks().value_lengths().to_numpy() if len(occ) else np.empty(0, int)
        place = np.repeat(np.searchsorted(self.cid.astype(str), occ["cid"].to_numpy(zero_copy_only=False).astype(str)), n) if len(occ) else np.empty(0, int)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        coded = occ["terms"].combine_chunks().flatten().dictionary_encode() if n.sum() else None
        code = coded.indices.to_numpy() if coded else np.empty(0, int)
        order = np.lexsort((pos, place, code))
        self.doc, self.pos = place[order], pos[order]
        self.term = {t: i for i, t in enumerate(coded.dictionary.to_pylist())} if coded else {}
        self.start = np.searchsorted(code[order], np.arange(len(self.term) + 1))

    def _places(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        i = self.term.get(term)
        a, b = (self.start[i], self.start[i + 1]) if i is not None else (0, 0)
        return self.doc[a:b], self.pos[a:b]

    def _frequencies(self, parts: list[str]) -> np.ndarray:
        """How often a phrase of tokens occurs in each chunk."""
        doc, at = self._places(parts[0])
        at = doc * (1 << 32) + at
        for i, p in enumerate(parts[1:], 1):
            d, q = self._places(p)
            at = np.intersect1d(at, d * (1 << 32) + q - i, assume_unique=True)
        return np.bincount(at >> 32, minlength=len(self.cid))

    def keyword_ranks(self, query: str | None, pool: int) -> list[int]:
        """Places of the best chunks by BM25, best first."""
        n = len(self.cid)
        score, any_ = np.zeros(n), np.zeros(n, bool)
        for p, times in phrases(query).items():
            tf = self._frequencies(p.split(" "))
            hit = tf > 0
            df = int(hit.sum())
            if not df:
                continue
            raw = math.log((n - df + 0.5) / (df + 0.5))
            norm = tf[hit] + K1 * (1 - B + B * self.dl[hit] / self.dl.mean())
            score[hit] += (raw if raw > 0 else IDF_FLOOR) * (tf[hit] * (K1 + 1)) / norm * times
            any_ |= hit
        found = np.flatnonzero(any_)
        return found[np.lexsort((found, -np.round(score[found], 9)))][:pool].tolist()

    def vector_ranks(self, query: str | None, pool: int) -> list[int]:
        """Places of the nearest chunks, nearest first."""
        if not len(self.vec):
            return []
        q = np.asarray(vectors.embedder(self.model, self.dim)([query or ""])[0], float)
        near = self.sq - 2 * self.vec @ q
        some = min(len(near), pool + 16)
        at = np.sort(np.argpartition(near, some - 1)[:some]) if some < len(near) else np.arange(len(near))
        d = np.sqrt(((self.vec[at] - q) ** 2).sum(1))
        return self.has_vec[at[np.argsort(d, kind="stable")[:pool]]].tolist()

    def search(self, query: str | None, k: int, config: RecallConfig, now: float) -> list[dict]:
        """The hits of one query in order, as ``plans.recall`` gives them."""
        ranks: dict[int, list] = {}
        for channel, found in enumerate((self.vector_ranks(query, config.vec_pool), self.keyword_ranks(query, config.fts_pool))):
            for r, i in enumerate(found):
                ranks.setdefault(i, [None, None])[channel] = r
        scored = []
        for i, pair in ranks.items():
            score = sum(1.0 / (config.rrf_k + r) for r in pair if r is not None)
            if config.half_life_days > 0:
                age = max(0.0, (now - self.mtime[i]) / 86400.0) if config.live_age else self.age[i]
                if not (self.evergreen[i] or math.isnan(age)):
                    score *= math.exp(-math.log(2.0) / config.half_life_days * age)
                score = round(score, 12)
            if config.min_score is None or score >= config.min_score:
                scored.append((-score, *(math.inf if r is None else r for r in pair), i))
        best = sorted(scored)[: fusion.candidates_needed(k)]
        chosen = fusion.mmr_select([set(word_list(self.text[b[-1]])) for b in best], k, config.mmr_lambda) if config.mmr_lambda < 1.0 else range(min(k, len(best)))
        hits = []
        for c in chosen:
            i = best[c][-1]
            text = self.text[i]
            hits.append({"id": self.cid[i], "score": shown(-best[c][0]), "file": self.path[i], "text": text, "snippet": text[: config.snippet_chars] if config.snippet_chars > 0 else text})
        return hits
