"""Cards: facts written as new notes of a directory, a file each."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import card_slug


def card_name(title: Column, content: Column, at: Column) -> Column:
    """File name of a card made at a time: ``card-<date>-<time>-<slug>.md``."""
    return F.concat(F.lit("card-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), card_slug(title, content), F.lit(".md"))


def card_body(title: Column, content: Column) -> Column:
    """Text of a card: its title, if there is one, as a heading, a blank line, the content and a newline."""
    heading = F.when(F.length(title) > 0, F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(heading, content, F.lit("\n"))


def cards(facts: DataFrame) -> DataFrame:
    """(file, body) of facts (title, content, at). Facts without content or time are none."""
    made = facts.where(F.col("content").isNotNull() & F.col("at").isNotNull())
    return made.select(card_name(F.col("title"), F.col("content"), F.col("at")).alias("file"), card_body(F.col("title"), F.col("content")).alias("body"))


def write_cards(facts: DataFrame, root: str) -> DataFrame:
    """Write the facts' cards below ``root``, a folder that executors share, and return (file).

    A card replaces one of the same name; it is written aside and renamed, so that readers never see half of it.
    """

    def run(batches):
        for pdf in batches:
            for name, body in zip(pdf["file"], pdf["body"]):
                aside = os.path.join(root, f".{name}.part")
                with open(aside, "w", encoding="utf-8", newline="") as f:
                    f.write(body)
                os.replace(aside, os.path.join(root, name))
            yield pdf[["file"]]

    return cards(facts).mapInPandas(run, "file string")
