"""Document and segment languages by error-correcting output codes over character n-grams.

Every language has a codeword of ``BITS`` bits. For each bit one binary linear classifier over hashed
n-grams within words (of 1 to 3 letters, word ends marked) predicts the bit of a segment's language.
Decoding adds, for each codeword, the logistic losses of its bits weighted by how reliable each
bit's classifier was on its training segments; the codeword with the least loss wins, the distance to the
runner-up gives the confidence, and a small distance flags the segment as ambiguous.

The classifiers are fitted here, by ridge regression, to a bounded sample of the table's own labelled
rows (``PER_LANGUAGE`` chunks a language, chosen by hash). Labels may be wrong: the first fits
are smooth enough not to learn single wrong labels; sample segments that their codes put elsewhere are
dropped before the last fit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectext as V

# The languages, and the notations under which labels name them.
LANGUAGES = ["en", "de", "fr", "es", "pt", "nl", "pl", "uk", "ru", "ja"]
NOTATIONS = {
    "en": ["en", "eng"], "de": ["de", "deu", "ger"], "fr": ["fr", "fra", "fre"], "es": ["es", "spa"], "pt": ["pt", "por"],
    "nl": ["nl", "nld", "dut"], "pl": ["pl", "pol"], "uk": ["uk", "ukr"], "ru": ["ru", "rus"], "ja": ["ja", "jpn"],
}

#: The script of each language. A segment without a letter of its script is not in that language.
SCRIPT = {"uk": 1, "ru": 1, "ja": 2}
BITS = 20
DIM = 1 << 12
#: Labelled chunks, and segments of them, that a language's sample may have. This bounds the fit.
PER_LANGUAGE = 200
#: Ridge of the first and of later fits, as shares of the mean squared length of a sample row.
RIDGES = (3.0, 1.0, 0.1)
#: Softmax sharpness of losses, and the confidence below which a segment is ambiguous.
SHARP, AMBIGUOUS = 1.0, 0.6
#: Steepness of the logistic loss in the regressed bit.
SLOPE = 3.0


def label_language(lang: Column) -> Column:
    """Two-letter code of a delivered label: case, region and three-letter codes resolved; null if it names no known language."""
    primary = F.split(F.lower(F.trim(lang)), "[-_]")[0]
    known = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for n in names for x in (n, code)])
    return F.try_element_at(known, primary)


# --- segments ------------------------------------------------------------------------------------
# Removed with what they enclose: code, formulas, comments and templates, each a boundary.
_CODE = re.compile(r"\n[ \t>]*(```|~~~)[^\n]*\n.*?(?:\n[ \t>]*\1[ \t]*(?=\n|\Z)|\Z)|<(pre|code|style|script|syntaxhighlight|source|nowiki|math)\b[^>]*>.*?(?:</\2\s*>|\Z)|\\begin\{(equation|align|verbatim|lstlisting)\*?\}.*?(?:\\end\{\3\*?\}|\Z)|\$\$.*?\$\$|<!--.*?(?:-->|\Z)|\{\{.*?\}\}|\\(?:\[.*?\\\]|\(.*?\\\))|<h[1-6][^>]*>.*?</h[1-6]>|\[\[[Cc]ategory:[^\]]*\]\]|\\(?:sub)*section\*?\{[^}\n]*\}", re.S)
_TITLE = re.compile(r"\n[ \t]*#{1,6}[ \t][^\n]*|\n[ \t]*=+[^=\n]+=+[ \t]*(?=\n|\Z)|\n[^\n]+\n(?:=+|-+)[ \t]*(?=\n|\Z)")
_SPAN = re.compile(r"`[^`\n]*`|\$(?![\s\d])[^$\n]*(?<!\s)\$(?!\d)")  # an amount opens no formula
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_MARK = re.compile(r"\n(?:[ \t]*(?=\n)|[ \t>]*(?:[-*+#:]+[ \t]+(?:\[[ xX]\][ \t]*)?|\d+[.)][ \t]+|>|[|!][-}+]?|\{\|))")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]")
_TEX = re.compile(r"\\(?:begin|end)\{\w+\*?\}|\\item\b|\\[a-zA-Z]+\*?")
_STOP = re.compile(r"[.!?…][\"'”»)\]*_~]*(?=\s|\Z|\x00)|[。！？]")
_FIELD = re.compile(r"[\s\ufeff]*[\w\-]+\s*[:=]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


def is_fields(text: str) -> bool:
    """Whether a text has only ``name: value`` or ``name = value`` lines, or such fields separated by ``;``."""
    if not _FIELD.match(text):
        return False
    parts = [p for p in re.split(r"[\r\n;]+", text) if p.strip("\ufeff \t")]
    return len(parts) > 1 and all(_FIELD.match(p) for p in parts)


def segments(text: str) -> list[str]:
    """Sentences of a text and runs that end without a stop, without code, formulas, titles and markup."""
    t = "\n" + (text.replace("\r\n", "\n") if "\r" in text else text)
    # each pattern runs only over texts that have what it starts with
    if "`" in t or "~~~" in t or "<" in t or "\\" in t or "$$" in t or "{{" in t or "[[" in t:
        t = _CODE.sub("\n\n", t)
    if "\n#" in t or "\n=" in t or "\n-" in t or "\n " in t:
        t = _TITLE.sub("\n\n", t)
    if "`" in t or "$" in t:
        t = _SPAN.sub(" ", t)
    if "[" in t:
        t = _LINK.sub(lambda m: m[1] or m[2] or " ", t)
    if "<" in t:
        t = _TAG.sub("\x00", t)
    if "\\" in t:
        t = _TEX.sub("\x00", t)
    t = _STOP.sub("\\g<0>\x00", _MARK.sub("\x00", t))
    if "|" in t:
        t = t.replace("||", "\x00").replace(" | ", "\x00")
    return [s for s in t.split("\x00") if len(s) > 1 and not s.isspace()]


def sentence_size(segment: str) -> int:
    """Words of a segment; of a run in kana or ideographs, two characters count as one."""
    n = len(_WORD.findall(segment))
    return n if segment.isascii() else n + len(_CJK.findall(segment)) // 2


def whole(segment: str, size: int | None = None) -> bool:
    """Whether a segment is a whole sentence: four words or more that end in a stop, or eight without one."""
    size = sentence_size(segment) if size is None else size
    return size >= 8 or size >= 4 and segment.rstrip("\"'”»)]*_~ \t\n")[-1:] in ".!?…。！？"


# --- features ------------------------------------------------------------------------------------
def _word_features(texts: list[str]):
    """(bins, word of each bin, word of each occurrence, text of each occurrence) for the letters of texts."""
    code, offsets = V.codes([t.lower() for t in texts])
    starts, ends = V.spans(code, offsets, V.letter_table())
    doc = np.searchsorted(offsets, starts, "right") - 1
    uniq, first, inv = np.unique(V.span_hashes(code, starts, ends), return_index=True, return_inverse=True)
    # the different words in a row, each between two marks
    s, n = starts[first], (ends - starts)[first]
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + 2, out=at[1:])
    row = np.full(at[-1], 1, np.uint32)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row[np.repeat(at[:-1] + 1, n) + inner] = code[np.repeat(s, n) + inner]
    owner = np.repeat(np.arange(len(n)), n + 2)
    c = V.prefix(row)
    _, down = V.powers(len(row) + 1)
    bins, words = [], []
    for k in (1, 2, 3):
        if len(row) < k:
            break
        i = np.arange(len(row) - k + 1)
        ok = owner[: len(i)] == owner[k - 1 :]
        if k == 1:
            ok &= row[: len(i)] != 1
        h = V.mix((c[k:] - c[:-k]) * down[: len(i)] + V.U(k))[ok]
        bins.append((h & V.U(DIM - 1)).astype(np.int64))
        words.append(owner[: len(i)][ok])
    return np.concatenate(bins), np.concatenate(words), inv, doc, len(uniq)


def features(texts: list[str]) -> np.ndarray:
    """Dense rows of relative n-gram frequencies; for the bounded sample only."""
    x = np.zeros((len(texts), DIM), np.float32)
    bins, words, inv, doc, n = _word_features(texts)
    order = np.argsort(words, kind="stable")
    bins, at = bins[order], np.searchsorted(words[order], np.arange(n + 1))
    size = (at[1:] - at[:-1])[inv]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    np.add.at(x, (np.repeat(doc, size), bins[np.repeat(at[:-1][inv], size) + inner]), 1)
    return x / np.maximum(1, x.sum(1, keepdims=True))


def codewords(n: int = len(LANGUAGES), bits: int = BITS) -> np.ndarray:
    """n codewords of +-1 far apart in Hamming distance, no bit the same for all: the best of seeded draws."""
    rng, best, apart = np.random.default_rng(20), None, -1
    for _ in range(400):
        m = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        if (np.abs(m.sum(0)) == n).any():
            continue
        d = (bits - m @ m.T) // 2
        least = d[~np.eye(n, dtype=bool)].min()
        if least > apart:
            best, apart = m, least
    return best


def scripts_of(texts: list[str]) -> np.ndarray:
    """Whether each text has Latin, Cyrillic, and kana or ideographic letters; one without any has all."""
    code, offsets = V.codes(texts)
    out = np.zeros((len(texts), 3), bool)
    is_letter = V.letter_table()[code]
    for k, hit in enumerate((is_letter & (code < 0x250), (code >= 0x400) & (code < 0x530), (code >= 0x3040) & (code < 0xA000))):
        out[np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1, k] = True
    out[~out.any(1)] = True
    return out


class Model:
    """Bit classifiers (weights and bias), their reliabilities, and the code."""

    def __init__(self, weights, bias, alpha, code):
        self.weights, self.bias, self.alpha, self.code = weights, bias, alpha, code

    def margins(self, texts: list[str]) -> np.ndarray:
        """The bit classifiers' outputs for each text."""
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float32)
        if not any(texts):
            return out
        bins, words, inv, doc, n = _word_features(texts)
        if not n:
            return out
        order = np.argsort(words, kind="stable")
        bins, words = bins[order], words[order]
        have, first = np.unique(words, return_index=True)
        per = np.zeros((n, self.weights.shape[1]), np.float32)
        for s in range(0, len(have), 4096):  # bounded intermediate
            a, b = first[s], first[s + 4096] if s + 4096 < len(have) else len(bins)
            per[have[s : s + 4096]] = np.add.reduceat(self.weights[bins[a:b]], first[s : s + 4096] - a)
        size = np.bincount(words, minlength=n).astype(np.float32)
        docs, at = np.unique(doc, return_index=True)
        total = np.add.reduceat(size[inv], at)
        out[docs] += np.add.reduceat(per[inv], at) / np.maximum(1, total)[:, None]
        return out

    def decode(self, margins: np.ndarray, scripts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(language index, confidence): loss-weighted decoding to the nearest codeword.

        With ``scripts`` (from ``scripts_of``) only codewords of languages whose script occurs compete.
        """
        # log(1 + e^-z), z the bit's margin, for both signs of each bit, weighted, summed over the bits of each codeword
        plus = np.logaddexp(0, -SLOPE * margins) * self.alpha
        minus = np.logaddexp(0, SLOPE * margins) * self.alpha
        loss = plus @ (self.code.T > 0) + minus @ (self.code.T < 0)
        if scripts is not None:
            own = np.array([SCRIPT.get(c, 0) for c in LANGUAGES])
            loss = np.where(scripts[:, own], loss, loss.max() + 50)
        z = -SHARP * (loss - loss.min(1, keepdims=True))
        p = np.exp(z)
        return loss.argmin(1), p.max(1) / p.sum(1)


def fit(texts: list[str], labels: list[int], code: np.ndarray | None = None) -> Model:
    """Fit the bit classifiers to labelled segments, each time without those the fit before put elsewhere."""
    code = codewords() if code is None else code
    x, y = features(texts), np.asarray(labels)
    keep = np.arange(len(y))
    for ridge in RIDGES:
        xs, t = x[keep], code[y[keep]].astype(np.float32)
        # each language weighs the same, however many segments its sample has
        n = np.bincount(y[keep], minlength=len(code))
        w = np.sqrt(len(keep) / (np.maximum(1, n) * (n > 0).sum()))[y[keep]][:, None].astype(np.float32)
        mean, bias = (xs * w**2).mean(0), (t * w**2).mean(0)
        a = (xs - mean) * w
        gram = (a @ a.T).astype(float)
        gram[np.diag_indices(len(gram))] += ridge * np.trace(gram) / len(gram)
        weights = (a.T @ np.linalg.solve(gram, (t - bias) * w).astype(np.float32)).astype(np.float32)
        shift = bias - mean @ weights
        f = x @ weights + shift
        wrong = np.mean(f[keep] * t <= 0, 0)
        # an AdaBoost-like weight: what a bit says counts by the log odds that it is right
        alpha = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05)
        model = Model(weights, shift, (alpha / alpha.mean()).astype(np.float32), code)
        right = np.flatnonzero(model.decode(f)[0] == y)
        keep = right if len(right) else keep
    return model


def sample(chunks: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[int]]:
    """At most ``per_language`` whole segments for each language from labelled rows, chosen by hash of the cid."""
    label = label_language(F.col("lang"))
    rows = chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", label.alias("label")).where(F.col("label").isNotNull())
    # which rows, from two narrow columns; of repeated rows the hash is the same and either will do
    order = W.partitionBy("label").orderBy(F.xxhash64("cid"), "cid")
    ids = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("cid", "label").distinct()
    # at most per_language * len(LANGUAGES) rows: a proven bound for the broadcast and for the driver
    got = chunks.select("cid", "text").join(F.broadcast(ids), "cid").dropDuplicates(["cid"]).orderBy("cid").toPandas()
    texts, labels, n = [], [], dict.fromkeys(LANGUAGES, 0)
    for text, lang in zip(got["text"], got["label"]):
        if is_fields(text):
            continue
        for s in segments(text)[:2]:
            if n[lang] < per_language and whole(s):
                n[lang] += 1
                texts.append(s)
                labels.append(LANGUAGES.index(lang))
    return texts, labels


SEGMENTS = "cid string, label string, seg int, lang string, confidence double, ambiguous boolean, is_whole boolean, letters int"


def segment_languages(chunks: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(cid, label, seg, lang, confidence, ambiguous, is_whole, letters): a row for each segment of each chunk.

    A chunk of fields only is one English segment. Chunks without any segment (null or empty texts,
    code only) give no row. Repeated rows of one cid give repeated rows here. If the table has no
    labelled row to fit on, every row but those of fields has the language null and confidence 0.
    """
    if model is None:
        texts, labels = sample(chunks, per_language)
        model = fit(texts, labels) if len(set(labels)) > 1 else None
    bc = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = bc.value
        names = np.array(LANGUAGES, object)
        for pdf in batches:
            cids, labels, texts = pdf["cid"].to_numpy(), pdf["label"].to_numpy(), pdf["text"].tolist()
            for i, j in V.blocks(texts):
                owner, no, seg, fixed = [], [], [], []
                for d in range(i, j):
                    if is_fields(texts[d]):
                        owner.append(d), no.append(0), seg.append(""), fixed.append(True)
                        continue
                    for q, s in enumerate(segments(texts[d])):
                        owner.append(d), no.append(q), seg.append(s), fixed.append(False)
                if not owner:
                    continue
                fixed = np.array(fixed)
                if model is None:
                    best, conf = np.zeros(len(seg), int), np.zeros(len(seg))
                    lang = np.full(len(seg), None, object)
                else:
                    best, conf = model.decode(model.margins(seg), scripts_of(seg))
                    lang = names[best]
                lang[fixed], conf[fixed] = "en", 1.0
                letters = np.fromiter(map(sentence_size, seg), np.int32, len(seg))
                full = np.fromiter(map(whole, seg, letters.tolist()), bool, len(seg)) | fixed
                yield pd.DataFrame({"cid": cids[owner], "label": labels[owner], "seg": no, "lang": lang, "confidence": conf, "ambiguous": conf < AMBIGUOUS, "is_whole": full, "letters": letters})

    rows = chunks.where(F.col("cid").isNotNull() & F.col("text").isNotNull()).select("cid", label_language(F.col("lang")).alias("label"), "text")
    return rows.mapInPandas(run, SEGMENTS)


def chunk_segments(chunks: DataFrame) -> DataFrame:
    """``segment_languages`` with each chunk's segments once: repeated rows are dropped after the texts, which aren't shuffled.

    A cid delivered with different labels keeps the smallest of them.
    """
    rest = [c.split()[0] for c in SEGMENTS.split(", ") if c.split()[0] not in ("cid", "seg")]
    got = segment_languages(chunks).groupBy("cid", "seg").agg(F.min(F.struct(*rest)).alias("s"))
    return got.select("cid", "s.label", "seg", *[f"s.{c}" for c in rest if c != "label"])


def document_languages(segs: DataFrame) -> DataFrame:
    """(cid, label, lang, confidence, sentences, n_langs): the languages of each chunk's whole sentences.

    Ambiguous segments count only towards a language that another, unambiguous sentence of the chunk has.
    If all whole sentences of a chunk are ambiguous, it has the language of the surest one, with its low confidence.
    """
    good = segs.where("is_whole and lang is not null")
    per = good.groupBy("cid", "lang").agg(
        F.max("label").alias("label"), F.max("confidence").alias("confidence"), F.countDistinct("seg").alias("sentences"), F.min("ambiguous").alias("unsure")
    )
    own = W.partitionBy("cid")
    first = F.row_number().over(own.orderBy("unsure", F.desc("confidence"), "lang"))
    sure = per.withColumn("first", first).where("not unsure or first = 1").drop("unsure", "first")
    return sure.withColumn("n_langs", F.count(F.lit(1)).over(own))


def found(chunks: DataFrame) -> DataFrame:
    """p4_found: (cid, lang) of chunks whose label is missing or wrong or whose text has several languages."""
    docs = document_languages(segment_languages(chunks))
    right = F.max(F.col("lang") == F.col("label")).over(W.partitionBy("cid"))
    docs = docs.withColumn("right", F.coalesce(right, F.lit(False)))
    return docs.where((F.col("n_langs") > 1) | F.col("label").isNull() | ~F.col("right")).select("cid", "lang")
