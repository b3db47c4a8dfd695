import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memweft import RecallConfig
from memweft.operators import fusion, keyword, report, vectors
from memweft.plans import recall as R

DOCS = [("t", "a", "alpha beta beta"), ("t", "b", "alpha parse_config"), ("t", "c", "config parse gamma"), ("t", "d", ""), ("t", "e", None), ("u", "f", "alpha alpha")]


def chunks(spark):
    return spark.createDataFrame(DOCS, "tenant string, cid string, text string")


def scores(spark, query, tenant="t"):
    q = spark.createDataFrame([(tenant, 1, query)], "tenant string, qid int, query string")
    return {r["cid"]: r["score"] for r in keyword.bm25(chunks(spark), q).collect()}


def test_bm25_closed_form(spark):
    got = scores(spark, "beta")
    avg = (3 + 3 + 3 + 0 + 0) / 5
    want = keyword.idf(5, 1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert set(got) == {"a"} and math.isclose(got["a"], want, rel_tol=1e-12)


def test_bm25_repeated_term_counts_twice(spark):
    assert math.isclose(scores(spark, "beta beta")["a"], 2 * scores(spark, "beta")["a"], rel_tol=1e-12)


def test_bm25_phrase_needs_order(spark):
    assert set(scores(spark, "parse_config")) == {"b"}


def test_bm25_keeps_tenants_apart(spark):
    assert set(scores(spark, "alpha", "u")) == {"f"}
    assert scores(spark, "alpha", "nobody") == {}


@pytest.mark.parametrize("query", ["", "_", None, "zzz", '"OR AND NEAR(" *'])
def test_bm25_odd_queries(spark, query):
    assert scores(spark, query) == {}


def test_nearest_is_exact_with_ties_by_id(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    base = spark.createDataFrame([("m" if i % 3 else "n", i, x[i].tolist()) for i in range(300)] + [("m", 900, None), ("m", 901, [1.0])], "g string, id long, vec array<float>")
    got = vectors.nearest(base, base.where("id % 20 = 0").withColumnRenamed("id", "qid"), "g", 7).collect()
    for q in range(0, 300, 20):
        same = [i for i in range(300) if (i % 3 > 0) == (q % 3 > 0)]
        want = sorted(same, key=lambda i: (((x[i] - x[q]) ** 2).sum(), i))[:7]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_l2_expression(spark):
    r = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>").select(vectors.l2_distance(F.col("a"), F.col("b"))).first()
    assert r[0] == 5.0


def test_embedder_is_per_model_and_deterministic():
    a, b = vectors.embedder("signed-hash-16", 16), vectors.embedder("signed-hash-32", 32)
    assert a(["x y"]).shape == (1, 16) and b(["x y"]).shape == (1, 32)
    assert np.allclose(np.linalg.norm(a(["x y z"])), 1) and not a([""]).any()
    with pytest.raises(RuntimeError):
        vectors.embedder("no-such-model", 8)


def test_rrf_and_order(spark):
    vec = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "qid int, cid string, vec_rank int")
    fts = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "qid int, cid string, fts_rank int")
    rows = fusion.ranked(fusion.reciprocal_rank_fusion(vec, fts, 60, ["qid"]).withColumnRenamed("fused", "score"), ["qid"]).orderBy("i").collect()
    assert [r["cid"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == 1 / 61 + 1 / 60


def test_decay(spark):
    df = spark.createDataFrame([(1.0, 30.0, False), (1.0, 30.0, True), (1.0, None, False), (1.0, 30.0, None)], "s double, a double, e boolean")
    got = [r[0] for r in df.select(fusion.decayed(F.col("s"), F.col("a"), F.col("e"), 30.0)).collect()]
    assert got == pytest.approx([0.5, 1.0, 1.0, 0.5])


def plain_mmr(tokens, k, lam):
    n = len(tokens)
    if lam >= 1 or n <= k:
        return list(range(min(n, k)))
    sets, chosen = [set(t) for t in tokens], []
    while len(chosen) < k:
        best = max((i for i in range(n) if i not in chosen), key=lambda i: (lam * (1 - i / n) - (1 - lam) * max([len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen], default=0.0), -i))
        chosen.append(best)
    return chosen


@pytest.mark.parametrize("seed", range(8))
def test_mmr(seed):
    rng = np.random.default_rng(seed)
    tokens = [[f"w{x}" for x in rng.integers(0, 8, rng.integers(0, 6))] for _ in range(20)]
    for lam in (0.0, 0.3, 0.7, 1.0):
        assert fusion.mmr_select(tokens, 5, lam) == plain_mmr(tokens, 5, lam)
    assert fusion.mmr_select([], 5, 0.7) == []


def test_hits_keep_whole_text_and_cut_snippets(spark):
    rows = [("t", "a", "p.md", "word " * 80, 0.0, False), ("t", "b", "q.md", "other", 0.0, False)]
    ch = spark.createDataFrame(rows, "tenant string, cid string, path string, text string, age_days double, evergreen boolean")
    q = spark.createDataFrame([("t", 1, "word", 5), ("nobody", 2, "word", 5), ("t", 3, "", 5)], "tenant string, qid int, query string, k int")
    cfg = RecallConfig(model="signed-hash-16", dim=16, snippet_chars=7)
    vec = lambda d, c: d.withColumn("vec", vectors.embed(F.col(c), cfg.model, cfg.dim))
    got = R.recall(ch, vec(ch, "text").select("tenant", "cid", "vec"), q, vec(q, "query").select("tenant", "qid", "vec"), cfg).collect()
    one = [r for r in got if r["qid"] == 1]
    assert [r["id"] for r in sorted(one, key=lambda r: r["pos"])] == ["a", "b"]
    assert one[0]["snippet"] in ("word wo", "other") and max(len(r["text"]) for r in one) == 400
    assert {r["qid"] for r in got} == {1, 3}  # the empty query still has its nearest vectors


@pytest.mark.parametrize("n", [0, 1, 2, 3, 20, 41])
def test_p95_is_the_indexed_value(spark, n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 30, n).astype(float).tolist() + [None]
    lines = spark.createDataFrame([("recall", "t", x, None, False) for x in v], "event string, tenant string, latency_ms double, top_score double, empty boolean")
    r = report.overall(lines).first()
    s = sorted(v[:-1])
    assert r["latency_p95_ms"] == (s[int(n * 0.95)] if n > 2 else None)
    assert r["latency_p50_ms"] == (round(float(np.median(s)), 1) if n else None)
    assert r["recalls"] == n + 1 and r["avg_top_score"] is None


def test_hit_rates(spark):
    hits = spark.createDataFrame([("t", 1, 0, "a"), ("t", 1, 1, "b"), ("t", 2, 1, "b")], "tenant string, qid int, pos int, file string")
    wanted = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c")], "tenant string, qid int, file string")
    r = R.hit_rates(hits, wanted).first()
    assert (r["n"], r["hit1"], r["hit3"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3)) and r["mrr"] == pytest.approx(0.5)
