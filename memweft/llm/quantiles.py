"""Percentiles of very large columns: mergeable compactor hierarchies (KLL).

A sketch is a list of compactors. Level h holds values of weight 2**h. When the sketch is too large,
the lowest overfull level is sorted and every other value, from a random start, moves up one level.
Sketches merge level by level. Each compaction at level h moves any rank by at most 2**h, up or down
with equal odds, so by Hoeffding's inequality |rank error| <= sqrt(2 ln(2/delta) * err2) with
probability 1 - delta, where err2 adds 4**h for each compaction. err2 travels with the sketch, so the
bound that a result reports is the bound of exactly the compactions behind it. The coin of a compaction is a
checksum of its values: a task that is run again draws the same, and the odds are those of a hash over the data.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows for each part into which groups are spread, the least parts, and sketches that one task merges at a time.
PART, LEAST_PARTS, FAN_IN = 1_000_000, 8, 256
SKETCH = "n long, err2 double, sizes array<int>, vals array<double>"


class Kll:
    """One sketch; ``k`` is the size of the top compactor."""

    def __init__(self, k: int = 256, levels=None, n: int = 0, err2: float = 0.0):
        self.k, self.n, self.err2 = k, n, err2
        self.levels: list[np.ndarray] = levels or [np.empty(0)]

    def _cap(self, h: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - h)))

    def _compress(self) -> None:
        while sum(map(len, self.levels)) > sum(self._cap(h) for h in range(len(self.levels))):
            h = next(h for h, v in enumerate(self.levels) if len(v) > self._cap(h))
            if h + 1 == len(self.levels):
                self.levels.append(np.empty(0))
            v = np.sort(self.levels[h])
            keep, v = (v[:1], v[1:]) if len(v) % 2 else (v[:0], v)
            coin = zlib.crc32(v.tobytes(), self.n & 0xFFFFFFFF)
            start = (coin ^ coin >> 7 ^ coin >> 15) & 1
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], v[start::2]])
            self.levels[h] = keep
            self.err2 += 4.0**h

    def update(self, values: np.ndarray) -> Kll:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.n += len(values)
        self._compress()
        return self

    def merge(self, other: Kll) -> Kll:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
        self.n += other.n
        self.err2 += other.err2
        self._compress()
        return self

    def quantiles(self, qs) -> list[float]:
        """For each q the value at rank ceil(q*n); NaN when empty."""
        v = np.concatenate(self.levels)
        if not len(v):
            return [float("nan")] * len(qs)
        w = np.concatenate([np.full(len(x), 2.0**h) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        v, c = v[order], np.cumsum(w[order])
        at = np.searchsorted(c, np.ceil(np.asarray(qs) * c[-1]).clip(1))
        return [float(x) for x in v[at.clip(0, len(v) - 1)]]

    def epsilon(self, delta: float = 0.01) -> float:
        """Rank error as a share of n that is exceeded with probability ``delta`` at most."""
        return math.sqrt(2 * math.log(2 / delta) * self.err2) / self.n if self.n else 0.0

    def row(self) -> tuple:
        return self.n, self.err2, [len(v) for v in self.levels], np.concatenate(self.levels)

    @classmethod
    def of(cls, k, n, err2, sizes, vals) -> Kll:
        vals = np.asarray(vals, dtype=float)
        cuts = np.cumsum(np.asarray(sizes, dtype=int))[:-1]
        return cls(k, list(np.split(vals, cuts)), int(n), float(err2))


def parts_for(df: DataFrame) -> int:
    """Parts into which every group is spread: in proportion to all rows, so that a group which has most of them is spread too."""
    return max(LEAST_PARTS, -(-df.count() // PART))


def recall_values(log: DataFrame) -> DataFrame:
    """(tenant, day, salt, latency_ms, top_score) of each distinct recall line with a tenant.

    Lines equal but for ``line_no`` count once: they are told apart by a 128-bit hash over all other
    columns of the log that are named here (extra columns don't matter), so only the hash and the
    values are shuffled. A latency that is null, NaN, infinite or negative is null here, as is a
    score that is NaN. ``day`` is the day of ``ts`` since 1970, null for a null ``ts``.
    """
    whole = ["ts", "event", "tenant", "query", "n_results", "top_score", "top_file", "scores", "latency_ms", "empty"]
    # a null must hash unlike an absent column, hence the flags
    nulls = F.concat_ws("", *[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in whole])
    lat = F.col("latency_ms")
    good = lat.isNotNull() & ~F.isnan(lat) & (lat >= 0) & (lat < F.lit(float("inf")))
    score = F.col("top_score")
    return (
        log.where((F.col("event") == "recall") & F.col("tenant").isNotNull())
        .select(
            "tenant",
            F.floor(F.col("ts") / 86400).cast("int").alias("day"),
            F.when(good, lat).alias("latency_ms"),
            F.when(score.isNotNull() & ~F.isnan(score), score).alias("top_score"),
            F.xxhash64(*whole, nulls).alias("h1"),
            F.xxhash64(F.lit("second"), nulls, *whole).alias("h2"),
        )
        .withColumn("salt", F.pmod("h1", F.lit(parts_for(log))).cast("int"))
        # equal lines agree in tenant, day and salt: one shuffle serves this and the sketches by day
        .repartition("tenant", "day", "salt")
        .dropDuplicates(["tenant", "day", "salt", "h1", "h2"])
        .drop("h1", "h2")
    )


def _runs(pdf: pd.DataFrame, groups: list[str]):
    """(key, start, end) of the runs of equal keys in sorted rows; None stands for null."""
    if not len(pdf):
        return
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for g in groups:
        code = pd.factorize(pdf[g], use_na_sentinel=False)[0]
        new[1:] |= code[1:] != code[:-1]
    first = np.flatnonzero(new)
    keys = zip(*(pdf[g].iloc[first] for g in groups))
    for key, i, j in zip(keys, first, np.r_[first[1:], len(pdf)]):
        yield tuple(None if pd.isna(x) else x for x in key), i, j


def _folded(batches, groups: list[str], names: list[str], fold):
    """Fold the rows of each run of equal keys, across batches, and yield the sketches as rows."""
    done: list[tuple] = []
    last, state = None, {}

    def close():
        done.extend((*last, *tail, *s.row()) for tail, s in state.items())

    for pdf in batches:
        for key, i, j in _runs(pdf, groups):
            if key != last:
                if last is not None:
                    close()
                last, state = key, {}
            fold(state, pdf, i, j)
        if len(done) > 5000:
            yield pd.DataFrame(done, columns=names)
            done = []
    if last is not None:
        close()
    yield pd.DataFrame(done, columns=names)


def sketch(df: DataFrame, groups: list[str], fields: list[str], k: int = 256, salt: str | None = None) -> DataFrame:
    """One sketch per group and field: (groups..., field, n, err2, sizes, vals). Null values are left out.

    A hot group is spread over tasks by ``salt`` (an integer column of few values; without it, by a
    hash of the row), each of which sketches its part in order; the parts, at most one for each value
    of the salt, are then merged. No task ever holds a group's rows, only its open sketch.
    """
    types = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    names = [*groups, "field", "n", "err2", "sizes", "vals"]
    part = F.col(salt) if salt else F.pmod(F.xxhash64(*fields), F.lit(parts_for(df)))
    rows = df.select(*groups, *fields, part.alias("_salt"))
    keys = [*groups, "_salt"]
    if not salt:
        rows = rows.repartition(*keys)

    def fold(state, pdf, i, j):
        for f in fields:
            v = pdf[f].to_numpy(dtype=float)[i:j]
            v = v[~np.isnan(v)]
            if len(v):
                state.setdefault((f,), Kll(k)).update(v)

    def partial(batches):
        return _folded(batches, keys, [*groups, "_salt", "field", *names[-4:]], fold)

    parts = rows.sortWithinPartitions(*keys).mapInPandas(partial, f"{types}, _salt long, field string, {SKETCH}")
    if (n := parts_for(df)) > FAN_IN:  # a hot group has a sketch for each part: merged in two levels
        parts = parts.withColumn("_salt", F.floor(F.col("_salt") / math.isqrt(n)))
        parts = merge_sketches(parts, [*groups, "field", "_salt"], k)
    return merge_sketches(parts, [*groups, "field"], k)


def merge_sketches(sketches: DataFrame, groups: list[str], k: int = 256) -> DataFrame:
    """Merge the sketches of each group into one, such as the days of a tenant or the parts of a day."""
    types = ", ".join(f"`{g}` {sketches.schema[g].dataType.simpleString()}" for g in groups)
    names = [*groups, "n", "err2", "sizes", "vals"]

    def fold(state, pdf, i, j):
        for x in zip(*(pdf[c].iloc[i:j] for c in names[-4:])):
            one = Kll.of(k, *x)
            state[()] = state[()].merge(one) if () in state else one

    rows = sketches.select(*names).repartition(*groups).sortWithinPartitions(*groups)
    return rows.mapInPandas(lambda b: _folded(b, groups, names, fold), f"{types}, {SKETCH}")


def percentiles(sketches: DataFrame, qs: dict[str, float], k: int = 256, delta: float = 0.01) -> DataFrame:
    """Replace the sketch columns by one column per percentile and ``rank_error`` (a share of n)."""

    def read(n: pd.Series, err2: pd.Series, sizes: pd.Series, vals: pd.Series) -> pd.DataFrame:
        rows = []
        for x in zip(n, err2, sizes, vals):
            s = Kll.of(k, *x)
            rows.append((*s.quantiles(list(qs.values())), s.epsilon(delta)))
        return pd.DataFrame(rows, columns=[*qs, "rank_error"])

    udf = F.pandas_udf(read, ", ".join(f"{c} double" for c in [*qs, "rank_error"]))
    got: Column = udf("n", "err2", "sizes", "vals")
    return sketches.withColumn("_q", got).drop("err2", "sizes", "vals").select("*", "_q.*").drop("_q")


def exact_ranks(df: DataFrame, found: DataFrame, groups: list[str], fields: list[str], qs: dict[str, float]) -> DataFrame:
    """(groups..., field, percentile, n, within): whether each percentile of ``found`` is as near its rank as it says.

    ``within``: the share of values below it is at most q + rank_error, and that of values up to it at least q -
    rank_error. One pass over the values counts both for each group.
    """
    values = df.select(*groups, F.explode(F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for f in fields for i, x in enumerate((f, f))])).alias("field", "v")).where("v IS NOT NULL")
    asked = found.select(*groups, "field", "rank_error", F.explode(F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for q in qs for i, x in enumerate((q, q))])).alias("percentile", "x"))
    per = asked.groupBy(*groups, "field").agg(F.collect_list(F.struct("percentile", "x", "rank_error")).alias("asked"))  # a row for each percentile
    rows = values.join(per, [*groups, "field"]).select(*groups, "field", "v", F.explode("asked").alias("a"))
    counted = rows.groupBy(*groups, "field", "a.percentile", "a.rank_error").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("a.x")).alias("below"), F.count_if(F.col("v") <= F.col("a.x")).alias("upto"))
    q = F.create_map(*[F.lit(x) for item in qs.items() for x in item])[F.col("percentile")]
    within = (F.col("below") / F.col("n") <= q + F.col("rank_error")) & (F.col("upto") / F.col("n") >= q - F.col("rank_error"))
    return counted.select(*groups, "field", "percentile", "n", within.alias("within"))
