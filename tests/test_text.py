import fnmatch

import pytest
from pyspark.sql import functions as F

from memweft.functions import text as T
from memweft.operators.chunking import chunk_markdown


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Café parse_config", ["cafe", "parse", "config"]),
        ("Йод ёлка її", ["йод", "ёлка", "її"]),
        ("ß Ø ł ŝ", ["ß", "ø", "ł", "s"]),
        ("日本語 テスト", ["日本語", "テスト"]),
        ("ét", ["et"]),
        ("", []),
        (None, None),
        ("_ -- !", []),
    ],
)
def test_keyword_tokens(spark, text, tokens):
    assert one(spark, text, T.keyword_tokens("x")) == tokens


@pytest.mark.parametrize(
    ("query", "terms"),
    [
        ("What is the plan", ["plan"]),
        ("the of a", ["the", "of", "a"]),
        ('a "OR" NEAR(x:y)', ["or", "near"][1:] or []),
        ("x y", ["x", "y"]),
        ("plan plan", ["plan", "plan"]),
        (None, []),
        ("", []),
        ("_", ["_"]),
    ],
)
def test_query_terms(spark, query, terms):
    assert one(spark, query, T.query_terms("x")) == terms


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("---\ntags: x\n---\nbody", "body"),
        ("---\r\ntags: x\r\n---\r\nbody", "body"),
        ("---\n---\nbody", "---\n---\nbody"),
        ("x\n---\na\n---\nb", "x\n---\na\n---\nb"),
        ("---\na\n---\n---\nb\n---\nc", "---\nb\n---\nc"),
        (None, None),
    ],
)
def test_frontmatter(spark, text, want):
    assert one(spark, text, T.without_frontmatter(F.col("x"))) == want


def packed(text, n):
    """Chunks by a plain loop."""
    import re

    out, cur = [], ""
    for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        if len(cur) + len(p) < n:
            cur = f"{cur}\n\n{p}" if cur else p
        else:
            out += [cur] if cur else []
            cur = p
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("text", ["", "   \n ", "a", "a\n\nb\n \nc", "x" * 30, "a" * 9 + "\n\n" + "b" * 11 + "\n\nc\n\nd", "é" * 12 + "\n\n" + "日" * 7])
def test_chunks(spark, text):
    assert one(spark, text, chunk_markdown(F.col("x"), 20)) == packed(text, 20)


def test_chunks_of_null(spark):
    assert one(spark, None, chunk_markdown(F.col("x"), 20)) == []


@pytest.mark.parametrize("glob", ["*.md", "a/*", "?.md", "[ab].md", "[!a].md", ".obs/*", "a[", "x.y+z", "[]x].md", "*\\*"])
def test_globs(spark, glob):
    paths = ["a.md", "b.md", "a/b.md", ".obs/x", "a[", "xzy+z", "x.y+z", "].md", "x.md", "ab.md", "dir/a.md", "q\\z", "line\nbreak.md"]
    df = spark.createDataFrame([(p,) for p in paths], "x string")
    got = {r[0] for r in df.where(T.ignored(F.col("x"), [glob])).collect()}
    assert got == {p for p in paths if fnmatch.fnmatchcase(p, glob)}


@pytest.mark.parametrize(("path", "want"), [("MEMORY.md", True), ("a/memory-x.md", True), ("memory/a.md", False), ("x_reference_y.md", True), ("note.md", False), (None, False)])
def test_evergreen(spark, path, want):
    from memweft import RecallConfig

    assert one(spark, path, T.is_evergreen(F.col("x"), RecallConfig().evergreen_re)) == want


@pytest.mark.parametrize(
    ("title", "content", "want"),
    [("A b!", "c", "a-b"), (None, "Héllo wörld " * 9, "héllo-wörld-héllo-wörld-héllo-wörld-héll"), ("", "--x--", "x"), ("!!!", "y", "card"), ("日本 x", "z", "日本-x"), ("a" * 60, "z", "a" * 50)],
)
def test_cards(spark, tmp_path, title, content, want):
    """A card's name and text, as written and read back; a card of the same name is replaced."""
    import datetime as dt

    from memweft.sources import cards

    facts = spark.createDataFrame([(title, content, dt.datetime(2025, 3, 4, 5, 6, 7)), ("none", None, dt.datetime(2025, 1, 1)), ("none", "x", None)], "title string, content string, at timestamp")
    for _ in range(2):
        assert [r["file"] for r in cards.write_cards(facts, str(tmp_path)).collect()] == [f"card-20250304-050607-{want}.md"]
    (made,) = tmp_path.iterdir()
    assert made.name == f"card-20250304-050607-{want}.md" and made.read_text() == (f"# {title}\n\n" if title else "") + content + "\n"


def test_fold_map_rule():
    assert len(T.FOLD_FROM) == len(T.FOLD_TO) == 191
    assert T.FOLD_TO.isascii() and "й" not in T.FOLD_FROM
