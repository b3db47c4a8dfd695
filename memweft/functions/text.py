"""Text as Column expressions: tokens, query terms, front matter, slugs, globs, evergreen names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the keyword channel leaves out.
STOPWORDS = """
a an and are as at be by do does for from how i if in into is it its me my no not
of on or our so that the their them then there these they this to was we what when
where which who why will with you your
""".split()

# Combining marks that keyword tokens lose.
MARKS = "".join(
    map(chr, [0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331])
)


def fold_map() -> tuple[str, str]:
    """Lower-case letters that fold to ASCII, and what they fold to.

    The rule: a letter whose canonical decomposition is an ASCII letter and one mark; the long s and
    its dotted form are s. Letters of other scripts keep their marks.
    """
    pairs = {0x17F: "s", 0x1E9B: "s"}
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if c.islower() and len(d) == 2 and d[0].isascii() and d[0].isalpha():
            pairs[cp] = d[0]
    return "".join(map(chr, sorted(pairs))), "".join(pairs[cp] for cp in sorted(pairs))


FOLD_FROM, FOLD_TO = fold_map()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
WORD = r"[\p{L}\p{N}_]+"


def keyword_tokens(text: Column | str) -> Column:
    """Tokens of the keyword index: runs of letters and digits, folded to lower case without Latin diacritics."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.lower(F.translate(text, MARKS, "")), FOLD_FROM, FOLD_TO), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column | str) -> Column:
    """Runs of letters, digits and ``_`` of the text in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def query_terms(query: Column | str) -> Column:
    """Terms of a query: words without stopwords and single characters; all its words if none is left.

    Repeats are kept, as a repeated term counts twice. A null query has no terms.
    """
    raw = F.coalesce(words(query), F.array().cast("array<string>"))
    kept = F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_frontmatter(text: Column) -> Column:
    """Without one leading ``---`` block. The block has at least one inner line and its closing fence ends a line."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_evergreen(path: Column, pattern: str) -> Column:
    """Whether the file's base name starts with a match of ``pattern``, whatever its case."""
    return F.coalesce(basename(path).rlike(f"(?i)^(?:{pattern})"), F.lit(False))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a file glob, in which ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_/ -" else "\\" + c
    return f"(?s)\\A(?:{out})\\z"


def ignored(path: Column, globs) -> Column:
    """Whether any glob matches the whole path."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def card_slug(title: Column, content: Column) -> Column:
    """File name part of a card: the title or the first 40 characters, letters and digits kept, others dashes."""
    raw = F.lower(F.when(F.length(title) > 0, title).otherwise(F.substring(content, 1, 40)))
    slug = F.substring(F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}]", "-"), r"^-+|-+$", ""), 1, 50)
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit("card"))


def snippet(text: Column, n: int) -> Column:
    """The first n characters; the whole text for n <= 0."""
    return text if n <= 0 else F.substring(text, 1, n)
