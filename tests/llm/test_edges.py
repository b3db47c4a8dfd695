"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memweft.llm import canonical, knngraph, language, markup, mixing, neardup, packing, quantiles, spans

CHUNKS = "tenant string, cid string, path string, hash string, seq int, text string, age_days double, evergreen boolean, lang string"
CLASH = ["key", "cls", "h", "bucket", "same", "node", "label", "n", "salt", "a", "b", "sketch", "batch", "size", "piece", "u", "cells", "model_", "field", "day", "_salt"]
LONG = " ".join(f"word{i % 977} item{i}" for i in range(60_000)) + "."


def with_clashes(df):
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns])


def chunk_rows(spark, texts):
    rows = [("t", None if t == "NOCID" else f"c{i:03d}", f"p{i}.md", None, 0, None if t == "NOCID" else t, None, None, None) for i, t in enumerate(texts)]
    return with_clashes(spark.createDataFrame(rows, CHUNKS))


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"alpha{i} beta{i} gamma{i}" for i in range(30)) + "."
    near = base.replace("alpha3 ", "changed ")
    return chunk_rows(spark, [None, "", " \n\t", "x", "!!! ...", base, base, near, base.upper() + " !", LONG, LONG + " more", "NOCID", "﻿" + base, "日本語のテキストです。" * 20, "<b>", "&#xFFFFFF;", "\x00\x01", "```", "$", "{{", "퟿\U0001f600 x y z"])


@pytest.fixture(scope="module")
def none(spark):
    return with_clashes(spark.createDataFrame([], CHUNKS))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_near_duplicates(odd, none):
    got = pairs(neardup.found(odd.union(odd)))
    same = ("c005", "c006", "c008", "c012")
    want = {tuple(sorted((x, "c007"))) for x in same} | {("c009", "c010")}
    assert got == want
    assert neardup.found(none).count() == 0
    rows = {r["cid"]: r for r in neardup.groups(odd).collect()}
    of = {c: r["group_cid"] for c, r in rows.items()}
    assert {of[c] for c in (*same, "c007")} == {"c005"} and of["c009"] == of["c010"] == "c009"
    assert {rows[c]["class_cid"] for c in same} == {"c005"} and rows["c005"]["links"] == 1 and rows["c005"]["group_classes"] == 2
    # texts of fewer than three words are there too; those without letters are one record
    assert of["c001"] == of["c002"] == of["c004"] == "c001" and of["c003"] == "c003" and rows["c003"]["links"] == 0
    assert "c000" not in of and set(of) == {f"c{i:03d}" for i in range(1, 21) if i != 11} and neardup.groups(none).count() == 0
    pairs_ = [tuple(r) for r in neardup.representatives(odd).select("cid_a", "cid_b").collect()]
    assert sorted(pairs_) == [("c005", "c007"), ("c009", "c010")]
    r = neardup.recall(odd, 1).first()
    assert r["n_true"] == r["n_found"] == 2 and neardup.recall(none).first()["n_true"] == 0


def test_ledger_records(spark, odd, none):
    ledger = canonical.Ledger(spark, buckets=4)
    ledger.update(canonical.keyed(odd.union(odd)))
    rows = {r["first_cid"]: r for r in ledger.table().collect()}
    assert (rows["c005"]["copies"], rows["c005"]["n_rows"]) == (4, 8)
    assert rows["c001"]["copies"] >= 3  # empty, blank and punctuation only are one record
    assert "c000" not in rows
    empty = canonical.Ledger(spark, buckets=4)
    empty.update(canonical.keyed(none))
    assert empty.table().count() == 0
    empty.update(canonical.keyed(odd))
    empty.update(canonical.keyed(none))
    assert empty.table().count() == ledger.table().count()


def test_both_forms_of_the_key_agree(spark):
    """The expression and the batch form put the same texts together, odd white space and letters included."""
    rng = np.random.default_rng(11)
    parts = ["name", "Name", "value x", "ÜBER", "straße", "İ", "Σας", "١٢", "Ⅷ", "日本", "é", "e\u0301", ":", "=", ": ", " = ", "\n", "\r\n", ";", " ", "\u00a0", "\ufeff", "_", "-", "!", "\ue000", "\x0b", "\u2003", "a-b_c", "ǅ"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(3000)] + ["a: 1\nb: 2", "b = 2; a = 1", "a:1\r\n\r\nB:2", "a: 1\nb:", "\ufeffa: 1\n\u00a0b: 2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", canonical.canonical_key(F.col("text")).alias("k")).orderBy("i").collect()
    mine = canonical.canonical_hashes(texts).tolist()
    assert len(set(mine)) == len({bytes(r["k"]) for r in got}) == len({(m, bytes(r["k"])) for m, r in zip(mine, got)})


def test_ledger_is_durable_and_counts_once(spark, tmp_path, monkeypatch):
    def batch(rows):
        return canonical.keyed(spark.createDataFrame([(c, None, t) for c, t in rows], "cid string, hash string, text string"))

    root = str(tmp_path)
    monkeypatch.setattr(canonical, "FOLDERS", 2)
    canonical.Ledger(spark, root, buckets=4).update(batch([("c5", "Some text."), ("c6", "some TEXT"), ("c7", "other")]), "one")
    open_ = lambda: canonical.Ledger(spark, root)
    state = lambda: {r["first_cid"]: (r["copies"], r["n_rows"]) for r in open_().table().collect()}
    open_().update(batch([("c9", "unused")]), "one")  # the same delivery again
    assert state() == {"c5": (2, 3 - 1), "c7": (1, 1)}
    # a crash between the tables and the commit leaves the ledger as it was, and the retry counts once
    monkeypatch.setattr(canonical.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    more = batch([("c1", "some text"), ("c6", "Some Text"), ("c8", "new")])
    with pytest.raises(KeyboardInterrupt):
        open_().update(more, "two")
    monkeypatch.undo()
    monkeypatch.setattr(canonical, "FOLDERS", 2)
    assert state() == {"c5": (2, 2), "c7": (1, 1)}
    open_().update(more, "two")
    want = {"c1": (3, 4), "c7": (1, 1), "c8": (1, 1)}  # c6 was delivered again: a row more, no copy more
    assert state() == want
    for k in range(4):
        open_().update(batch([("c1", "some text"), (f"d{k}", "some text!")]), f"x{k}")
    assert state() == {**want, "c1": (7, 12)}
    members = open_().members().collect()
    assert len(members) == len({r["cid"] for r in members}) == 9 and max(len(v) for v in open_().log.last()["members"].values()) <= 3


def test_markup(odd, none):
    rows = {r["cid"]: r for r in markup.convert(odd).collect()}
    assert rows["c000"]["clean_text"] is None and rows["c000"]["kinds"] == []
    assert rows["c001"]["clean_text"] == "" and rows["c009"]["clean_text"] == LONG and rows["c009"]["kinds"] == []
    assert "NOCID" not in rows and markup.convert(none).count() == 0 and markup.found(none).count() == 0


def test_languages(odd, none):
    model = language.fit(["the river is near the stone bridge today"] * 5 + ["der alte Markt liegt hinter der neuen Brücke"] * 5 + ["これは日本語の文章です"] * 5, [0] * 5 + [1] * 5 + [9] * 5)
    rows = language.segment_languages(odd, model).collect()
    cids = {r["cid"] for r in rows}
    assert "c000" not in cids and "c001" not in cids and "c013" in cids
    assert {r["lang"] for r in rows if r["cid"] == "c013"} == {"ja"}
    assert language.segment_languages(none).count() == 0
    assert language.found(none).count() == 0
    # nothing labelled: no language is made up
    assert {r["lang"] for r in language.segment_languages(odd).collect()} == {None}


def test_vectors(spark):
    schema = "vec_id long, hash string, model string, vec array<float>"
    rng = np.random.default_rng(0)
    good = [(i, None, "m", rng.integers(-5, 6, 4).astype(float).tolist()) for i in range(60)]
    same = [(100 + i, None, "m", [9.0, 9.0, 9.0, 9.0]) for i in range(12)]
    bad = [(200, "h", "m", None), (201, "h", "m", [1.0]), (202, "h", "m", [0.0] * 4), (203, "h", "m", [1.0, float("nan"), 0.0, 0.0]), (204, "h", "m", [1.0, None, 0.0, 0.0]), (205, "h", "m", [float("inf")] * 4), (None, "h", "m", [1.0] * 4), (206, "h", None, [1.0] * 4), (207, "h", "x", [1.0] * 4), (300, "h", "k", [1.0, 2.0]), (301, "h", "k", [2.0, 2.0]), (400, "h", "one", [1.0])]
    cache = with_clashes(spark.createDataFrame(good + same + bad + good[:5], schema))
    models = spark.createDataFrame([("m", 4), ("k", 2), ("one", 1), ("absent", 3), (None, 2)], "model string, dim int")
    got = {}
    for r in knngraph.found(cache, models).collect():
        got.setdefault(r["vec_id"], []).append(r["near_id"])
    x = {i: v for i, _, _, v in good + same if any(v)}
    for i, v in x.items():
        want = sorted((j for j in x if j != i), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, x[j])), j))[:5]
        assert sorted(got[i]) == sorted(want), i
    assert got[300] == [301] and got[301] == [300] and 400 not in got and 200 not in got
    assert knngraph.found(cache.limit(0), models).count() == 0 and knngraph.found(cache, models.limit(0)).count() == 0


LOG = "line_no long, ts double, event string, tenant string, query string, n_results int, top_score double, top_file string, scores array<double>, latency_ms double, empty boolean"


def test_percentiles(spark):
    line = (1.0, "recall", "t", "q", 1, 0.5, "f", [0.5], 10.0, False)
    rows = [(1, *line), (2, *line), (3, None, *line[1:]), (4, *line[:2], None, *line[3:]), (5, line[0], "heal", *line[2:])]
    rows += [(10 + i, float(i), "recall", "t", None, None, None, None, None, v, None) for i, v in enumerate([None, float("nan"), -1.0, float("inf"), 20.0])]
    log = with_clashes(spark.createDataFrame(rows, LOG))
    values = quantiles.recall_values(log)
    assert values.count() == 7  # the second line is the first once more
    s = quantiles.sketch(values, ["tenant", "day"], ["latency_ms", "top_score"], salt="salt")
    got = {(r["day"], r["field"]): r["n"] for r in s.collect()}
    assert got == {(0, "latency_ms"): 2, (0, "top_score"): 1, (None, "latency_ms"): 1, (None, "top_score"): 1}
    whole = quantiles.percentiles(quantiles.merge_sketches(s, ["tenant", "field"]), {"p50": 0.5})
    assert {(r["field"], r["n"], r["p50"]) for r in whole.collect()} == {("latency_ms", 3, 10.0), ("top_score", 2, 0.5)}
    none = quantiles.sketch(quantiles.recall_values(log.limit(0)), ["tenant", "day"], ["latency_ms"], salt="salt")
    assert none.count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tenant string, path string, created_at timestamp"


def doc_rows(spark, texts, sources=None):
    sources = sources or [None] * len(texts)
    return with_clashes(spark.createDataFrame([(None if t == "NOID" else i, t, None, s, None, None, None, None) for i, (t, s) in enumerate(zip(texts, sources))], DOCS))


def test_packing(spark):
    docs = doc_rows(spark, [None, "", "one", "one", LONG[:50_000], "NOID", "word " * 40])
    limits = spark.createDataFrame([("small", 16), ("small", 16), ("none", 0), ("null", None), ("large", 4096)], "container string, capacity_tokens int")
    rows = packing.pack_all(docs, limits).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.measured(docs).collect()}
    assert set(sizes) == {2, 3, 4, 6}
    for name, cap in (("small", 16), ("large", 4096)):
        own = [r for r in rows if r["container"] == name]
        for d, n in sizes.items():
            pieces = [r["n_tokens"] for r in own if r["doc_id"] == d]
            assert sum(pieces) == n and (n > cap or len(pieces) == 1) and len(pieces) == -(-n // cap)
        bins = {}
        for r in own:
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
        assert max(bins.values()) <= cap and sorted(bins) == list(range(len(bins)))
    assert {r["container"] for r in rows} == {"small", "large"}
    assert packing.pack_all(docs.limit(0), limits).count() == 0 and packing.pack_all(docs, limits.limit(0)).count() == 0


def test_mixing(spark):
    texts = [f"text number {i} has words {i * 7}" for i in range(200)] + ["", None, "text number 1 has words 7", "NOID"]
    sources = [(" A ", "b", "C", None)[i % 4] for i in range(200)] + ["a", "a", "b", "a"]
    docs = doc_rows(spark, texts, sources)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("absent", 0.2, 3)], "source string, weight double, max_repeats int")
    rows = mixing.mix(docs, targets).collect()
    times = {}
    for r in rows:
        times[r["text"]] = times.get(r["text"], 0) + 1
        assert r["source"] in ("a", "b")
    by = {r["text"]: r["source"] for r in rows}
    assert all(n <= {"a": 1, "b": 2}[by[t]] for t, n in times.items())
    share = {r["source"]: (r["target_share"], r["actual_share"]) for r in mixing.shares(docs, targets).collect()}
    assert share["a"][0] == pytest.approx(0.625) and abs(share["a"][1] - 0.625) < 0.05
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.shares(docs.limit(0), targets).count() == 0


def test_spans(spark):
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdefgh ü日"), n))
    s160, s159 = text(160), text(159)
    docs = doc_rows(spark, [None, "", "short", text(50) + s160 + text(70), s160 + text(9), text(40) + s159 + "#" + text(30), "!" + s159 + "?", "NOID", "-" * 4000, "x" + "-" * 170, LONG, "z " + LONG[1000:9000], s160, s160])
    got = pairs(spans.found(docs))
    assert got == {(3, 4), (3, 12), (3, 13), (4, 12), (4, 13), (12, 13), (8, 9), (10, 11)}
    shared = {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(docs).collect()}
    assert shared[3] == 160 and shared[5] == 0 and shared[9] == 170 and shared[12] == 160 and shared[11] == 8000 and shared[0] == 0
    assert spans.found(docs.limit(0)).count() == 0 and spans.shared_share(docs.limit(0)).count() == 0
