"""Vectorised text primitives: code points, words and window hashes of many texts at once in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: equal in, equal out, else spread over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    return _powers(1 << max(21, int(n).bit_length()))


@cache
def word_table() -> np.ndarray:
    """Whether each code point is a letter, a digit or ``_``."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter or a combining mark inside a word."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def blocks(texts: list[str], most: int = 1_000_000):
    """Slices (start, end) of ``texts`` of at most ``most`` characters each, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one entry more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def prefix(code: np.ndarray) -> np.ndarray:
    """C with hash(i, j) = (C[j] - C[i]) * inverse_power[i] for the code points i..j-1."""
    up, _ = powers(len(code) + 1)
    out = np.zeros(len(code) + 1, U)
    np.cumsum((mix(code.astype(U) + U(1))) * up[: len(code)], out=out[1:])
    return out


def spans(code: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` characters; a run never crosses texts."""
    inside = table[code]
    edge = np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(code), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(code), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the characters of each span, the same wherever the span stands."""
    c = prefix(code)
    _, down = powers(len(code) + 1)
    return mix((c[ends] - c[starts]) * down[starts])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in lower case, and where each text's words start.

    A word is a maximal run of letters, digits and ``_``.
    """
    code, offsets = codes([t.lower() for t in texts])
    if not len(code):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    starts, ends = spans(code, offsets, word_table())
    return span_hashes(code, starts, ends), np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words from each word on, and the text each belongs to, in text order."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h * U(3) + word[i : n + i])
    whole = doc[:n] == doc[k - 1 :]
    return h[whole], doc[:n][whole]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values (len(x) - w + 1 of them), by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out
