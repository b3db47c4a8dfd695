"""Token counts by a public tokenizer's rank file, whose path is a parameter and which is never copied here."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Path of a rank file (a token in base64 and its rank on each line).
TOKENIZER = os.environ.get("MEMWEFT_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_made: dict[int, object] = {}


def encoding(data: bytes):
    """The tokenizer of a rank file's bytes; built once per process."""
    key = hash(data)
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


#: Characters that are encoded at once.
PIECE = 200_000


def count(enc, text: str) -> int:
    """Tokens of a whole text; very long ones piecewise, cut before a letter after a newline that no other white space precedes.

    The splitting pattern takes such a newline by itself, with or without the letter behind it, and merges never
    leave what the pattern splits off, so such a cut changes no token, whatever the rank file merges.
    """
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not (text[end].isalpha() and text[end - 1] == "\n" and not text[end - 2].isspace()):
            end += 1
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Tokens of ``text``; null for a null text. The file is read by the driver and broadcast (under 2 MB)."""
    with open(path or TOKENIZER, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        enc = encoding(data.value)
        return pd.Series(np.fromiter((-1 if t is None else count(enc, t) for t in texts), np.int64, len(texts))).replace(-1, None).astype("Int64")

    return tokens(text)
