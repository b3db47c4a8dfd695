"""Markdown-aware chunks with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_evergreen, strip, without_frontmatter


def chunk_markdown(text: Column, chunk_chars: int) -> Column:
    """Array of chunks: paragraphs split at blank lines and packed in order.

    A paragraph joins the current chunk while both are shorter than ``chunk_chars`` together (the blank
    line between them not counted); a longer paragraph is a chunk of its own, never split. An empty or
    null text has none.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, p):
        fits = F.length(acc["cur"]) + F.length(p) < chunk_chars
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        closed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(p).alias("cur"))

    done = F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))
    return F.coalesce(done, F.array().cast("array<string>"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, hash_: Column) -> Column:
    """Stable id: the hash of path, NUL and content hash."""
    return F.sha2(F.concat(path, F.lit("\u0000"), hash_), 256)


def first_of_equal(rows: DataFrame, *more: str) -> DataFrame:
    """(path, hash, more..., n_rows): of equal chunks (path, hash, seq, more...) of one file, the first by ``seq`` and what it has.

    Combined before it is shuffled, so that a chunk delivered many times costs a row a task.
    """
    return rows.groupBy("path", "hash").agg(F.min(F.struct("seq", *more)).alias("f"), F.count(F.lit(1)).alias("n_rows")).select("path", "hash", "f.seq", *[f"f.{c}" for c in more], "n_rows")


def chunk_files(files: DataFrame, config, now: float) -> DataFrame:
    """(tenant, cid, path, hash, seq, text, age_days, evergreen, mtime) of files (tenant, path, mtime, text); nothing is shuffled.

    ``path`` names one file. Of equal chunks of one file the first stays. Ages are taken at ``now`` and not below 0; a null
    mtime gives age 0. Files with null text have no chunks.
    """
    text = without_frontmatter(F.col("text")) if config.strip_frontmatter else F.col("text")
    placed = lambda c: F.filter(F.transform(c, lambda x, i: F.struct(i.alias("seq"), x.alias("text"))), lambda s: F.array_position(c, s["text"]) == s["seq"] + 1)
    # one lambda over the array of chunks, or the text would be cut for each of its uses
    first = F.transform(F.array(chunk_markdown(text, config.chunk_chars)), placed)[0]
    rows = files.select("tenant", "path", "mtime", F.inline(first))
    rows = rows.withColumn("hash", content_hash(F.col("text"))).withColumn("cid", chunk_id(F.col("path"), F.col("hash")))
    return rows.select(
        "tenant", "cid", "path", "hash", "seq", "text", F.coalesce(age_of("mtime", now), F.lit(0.0)).alias("age_days"), is_evergreen(F.col("path"), config.evergreen_re).alias("evergreen"), "mtime"
    )


def age_of(mtime: str, now: float) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(float(now)) - F.col(mtime)) / F.lit(86400.0))
