"""Long exact spans shared between records: winnowed windows, a count-min prefilter, exact grouping.

A window is ``width`` code points of a text. Winnowing keeps the windows that are smallest in some
run of ``length - width + 1`` starts, so two texts that share ``length`` code points verbatim share a
kept window inside the span. Tasks count kept windows in count-min sketches (``repeats``); a second pass groups
exactly only windows that a sketch says may be repeated. Sketches never count too low, so no repeated window
is lost; counting too high only costs a row.

Each occurrence carries the ``length - width`` code points to both sides of its window, which is all
that is needed to decide whether the shared span around it reaches ``length``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import vectext as V
from .repeats import maybe_repeated

#: The least length of a shared span, and the width of a window.
LENGTH, WIDTH = 160, 100
#: Groups of more exact copies than this are represented by their smallest member in pairs.
COPIES = 1000
#: Windows shared by more texts than this take the exact path through whole spans.
CROWD = 64
#: Texts with one span are cut into parts of this size on average when they are paired.
PART = 1000


def windows(texts: list[str], length: int = LENGTH, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept windows of texts: their hashes, the text's index, and where in it they start.

    All ties for the smallest are kept, so that what is kept depends on nothing but the span.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return np.empty(0, V.U), np.empty(0, np.int64), np.empty(0, np.int64)
    code, offsets = V.codes([texts[i] for i in long])
    c = V.prefix(code)
    _, down = V.powers(len(code) + 1)
    h = V.mix((c[width:] - c[:-width]) * down[: len(code) - width + 1])
    w = length - width + 1
    top = np.iinfo(np.uint64).max
    # windows and runs that cross into the next text don't exist
    start = np.repeat(offsets[:-1], np.diff(offsets))[: len(h)]
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
    at = np.arange(len(h))
    h[at + width > end] = top
    low = V.sliding_min(h, w)
    # a run counts only if it lies in one text: its last window must end there
    low[np.arange(len(low)) + length > end[: len(low)]] = 0
    pad = np.zeros(w - 1, V.U)
    best = V.sliding_max(np.concatenate([pad, low, pad]), w)
    keep = np.flatnonzero((best == h) & (h != top) & (best != 0))
    doc = np.asarray(long)[np.searchsorted(offsets, keep, "right") - 1]
    return h[keep], doc, keep - start[keep]


def _kept(docs, length: int, width: int):
    """Keys of a batch of (doc_id, text): the kept windows, their document and where they start."""
    texts, ids, out = docs.column("text").to_pylist(), docs.column("doc_id").to_numpy(zero_copy_only=False), []
    for i, j in V.blocks(texts):
        h, doc, pos = windows(texts[i:j], length, width)
        out.append((h, ids[doc + i], pos.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, V.U), np.empty(0, np.int64), np.empty(0, np.int32))


#: Code points of a part of the texts on average (fewer parts than ``PARTS`` have so many, more have up to ``WIDE``), and bytes that a task packs at a time.
SHARE, PARTS, WIDE, PACK = 1 << 21, 1 << 9, 1 << 26, 1 << 25

_PACKED = "part int, texts boolean, n long, size long, data binary"
OCCURRENCES = "h long, same binary, pos int, cx int, around string, lead int"


def _by_part(doc: np.ndarray, parts: int):
    """(part, rows of it) for documents by their ids."""
    part = (((V.mix(doc.astype(np.int64).view(V.U)) >> V.U(32)) * V.U(parts)) >> V.U(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def _packed(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _PACKED.split(", ")])


def _together(batches, most: int):
    """Tables of some ``most`` bytes or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def occurrences(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """(h, same, pos, cx, around, lead) of windows that may be repeated, written to scratch.

    ``same`` names the text (128-bit hash). ``around`` is the window with its context, ``lead`` how much of it is before.
    A text that repeats a pattern has the same window in the same context at thousands of places; ``cx`` is the first
    of them, and only that row has the context. Copies of one text keep the rows of one of them in each part.

    Windows that may be repeated come back from their hash ranges and meet their texts in parts by document. Texts
    travel once, in compressed packs of one task and part; what a text has several times is found where it is whole.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= length)).select("doc_id", "text")
    chars = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    back = maybe_repeated(usable, lambda batch: _kept(batch, length, width), 2 * chars // (length - width + 2))
    side, parts = length - width, max(1, min(-(-chars // SHARE), max(PARTS, -(-chars // WIDE))))

    def places(batches):
        for t in _together(batches, PACK):
            h, owner, pos = (t.column(c).to_numpy() for c in ("h", "owner", "place"))
            yield _packed([(part, False, len(rows), 0, owner[rows].tobytes() + h[rows].tobytes() + pos[rows].tobytes()) for part, rows in _by_part(owner, parts)])

    def texts(batches):
        codec = pa.Codec("zstd", 3)
        for t in _together(batches, PACK):
            doc, text, out = t.column("doc_id").to_numpy(), t.column("text").cast(pa.large_binary()).to_pylist(), []
            size = np.fromiter(map(len, text), np.int64, len(text))
            for part, rows in _by_part(doc, parts):
                data = b"".join([doc[rows].tobytes(), size[rows].tobytes(), *(text[i] for i in rows.tolist())])
                out.append((part, True, len(rows), len(data), codec.compress(data, asbytes=True)))
            yield _packed(out)

    def meet(batches):
        codec, last = pa.Codec("zstd", 3), None
        for batch in batches:
            for part, is_texts, n, size, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part != last:
                    last, asked, owner, seen = part, [], None, set()
                if not is_texts:
                    asked.append((np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.int32, n, 16 * n)))
                    continue
                if not asked:
                    continue
                if owner is None:  # the places of a part come before its texts
                    owner, h, pos = (np.concatenate(x) for x in zip(*asked))
                    order = np.lexsort((pos, owner))
                    owner, h, pos = owner[order], h[order], pos[order]
                data = codec.decompress(data, size, asbytes=True)
                doc, ends = np.frombuffer(data, np.int64, n), 16 * n + np.cumsum(np.frombuffer(data, np.int64, n, 8 * n))
                first, end = np.searchsorted(owner, doc, "left"), np.searchsorted(owner, doc, "right")
                out = []
                for i in np.flatnonzero(first < end).tolist():
                    text = data[ends[i - 1] if i else 16 * n : ends[i]]
                    same = hashlib.md5(text).digest()
                    if same in seen:
                        continue
                    seen.add(same)
                    text, at = text.decode(), {}
                    for key, p in zip(h[first[i] : end[i]].tolist(), pos[first[i] : end[i]].tolist()):
                        if p + width > len(text):  # of another text with this id
                            continue
                        lead = min(p, side)
                        around = text[p - lead : p + width + side]
                        cx = at.setdefault((key, lead, around), p)
                        out.append((key, same, p, cx, around if cx == p else None, lead))
                if out:
                    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in OCCURRENCES.split(", ")])

    # four parts a task on average, however many partitions the session has by default
    rows = back.mapInArrow(places, _PACKED).union(usable.mapInArrow(texts, _PACKED))
    return materialize(rows.repartition(-(-parts // 4), "part").sortWithinPartitions("part", "texts").mapInArrow(meet, OCCURRENCES))


def contexts(occ: DataFrame) -> DataFrame:
    """(h, same, cx, around, lead): the different contexts that a window has in a text; all of a window in one task.

    For what a text shares with others one of the places of a context says it all.
    """
    return occ.where("pos = cx").select("h", "same", "cx", "around", "lead").repartition("h").groupBy("h", "same", "cx").agg(F.first("around").alias("around"), F.first("lead").alias("lead"))


def _reach(batches, length: int, width: int):
    """Extend each pair of windows over its context; keep pairs whose span reaches ``length``."""
    side = length - width
    for pdf in batches:
        if not len(pdf):
            continue
        n = len(pdf)
        ext = np.zeros((2, n), np.int64)
        for k, back in enumerate((True, False)):
            a = np.zeros((n, side), np.uint32)
            b = np.zeros((n, side), np.uint32)
            for m, xs, ls, blank in ((a, pdf["xa"], pdf["la"], 0x110000), (b, pdf["xb"], pdf["lb"], 0x110001)):
                parts = [x[:q][::-1] if back else x[q + width :] for x, q in zip(xs, ls)]
                lens = np.fromiter(map(len, parts), np.int64, n)
                flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
                inside = np.arange(side)[None, :] < lens[:, None]
                m[:] = blank
                m[inside] = flat
            ext[k] = np.cumprod(a == b, axis=1, dtype=np.int64).sum(1)
        ok = ext.sum(0) + width >= length
        # the windows themselves must agree too, not just their hashes
        wa = [x[q : q + width] for x, q in zip(pdf["xa"], pdf["la"])]
        wb = [x[q : q + width] for x, q in zip(pdf["xb"], pdf["lb"])]
        ok &= np.fromiter((x == y for x, y in zip(wa, wb)), bool, n)
        yield pd.DataFrame({"sa": pdf["sa"], "sb": pdf["sb"], "h": pdf["h"], "ca": pdf["ca"], "cb": pdf["cb"], "left": ext[0], "right": ext[1]})[ok]


class Shared:
    """What texts share, from the occurrences of windows that may be repeated.

    Windows of more than ``crowd`` contexts are not paired: each of their contexts is first turned into
    all the whole spans of ``length`` around the window, and only texts that agree in a whole span are
    paired, once for each span, so every pair is one that belongs in the result.
    """

    def __init__(self, occ: DataFrame, length: int = LENGTH, width: int = WIDTH, crowd: int = CROWD):
        self.occ, self.length, self.width = occ, length, width
        cx = contexts(occ)
        sizes = occ.where("pos = cx").select("h", "same", "cx").repartition("h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("h", "k")
        rows = materialize(cx.join(sizes, "h"))
        quiet, loud = rows.where(F.col("k") <= crowd).drop("k"), rows.where(F.col("k") > crowd).drop("k")
        side = lambda t: quiet.select("h", F.col("same").alias(f"s{t}"), F.col("cx").alias(f"c{t}"), F.col("around").alias(f"x{t}"), F.col("lead").alias(f"l{t}"))
        both = side("a").join(side("b"), "h").where("sa < sb").select("sa", "sb", "h", "ca", "cb", "xa", "xb", "la", "lb")
        self.pairs = both.mapInPandas(lambda b: _reach(b, length, width), "sa binary, sb binary, h long, ca int, cb int, left int, right int")
        self.spans = None
        if not loud.isEmpty():
            first = F.greatest(F.lit(0), F.col("lead") - (length - width))
            starts = F.sequence(first, F.least(F.col("lead"), F.length("around") - length))
            spans = loud.where((F.length("around") >= length) & (first <= F.length("around") - length)).withColumn("at", F.explode(starts))
            spans = spans.select("h", "same", "cx", "lead", "at", F.unhex(F.md5(F.substring("around", F.col("at") + 1, F.lit(length)))).alias("span"))
            many = spans.groupBy("h", "span").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("h", "span")
            self.spans = materialize(spans.join(many, ["h", "span"]))

    def links(self) -> DataFrame:
        """(sa, sb): pairs of texts that share a span."""
        got = self.pairs.select("sa", "sb")
        if self.spans is not None:
            one = materialize(self.spans.select("h", "span", "same").distinct())
            got = got.union(_paired(one, ["h", "span"], "same"))
        return got.distinct()

    def covered(self) -> DataFrame:
        """(same, p, e): stretches of each text that are shared, a row for each occurrence of a shared window."""
        p = self.pairs
        ends = p.select("h", F.col("sa").alias("same"), F.col("ca").alias("cx"), "left", "right").union(p.select("h", "sb", "cb", "left", "right"))
        if self.spans is not None:
            right = F.max(F.col("at") + self.length - F.col("lead") - self.width)
            ends = ends.union(self.spans.groupBy("h", "same", "cx").agg(F.max(F.col("lead") - F.col("at")).alias("left"), right.alias("right")))
        most = ends.groupBy("h", "same", "cx").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        at = self.occ.select("h", "same", "pos", "cx").join(most, ["h", "same", "cx"])
        return at.select("same", (F.col("pos") - F.col("left")).alias("p"), (F.col("pos") + self.width + F.col("right")).alias("e"))


def _paired(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(sa, sb): the names of every two rows that agree in ``keys``, the smaller first.

    Rows of a key with more than ``PART`` of them are cut into parts by hash, and each two parts meet in a task of their own.
    """
    hot = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("n")).where("n > 1")
    rows = rows.join(hot, keys, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(name, F.lit("part")), F.col("n")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = rows.select(*keys, F.col(name).alias("sa"), F.col("own").alias("pa"), each.alias("pb"))
    b = rows.select(*keys, F.col(name).alias("sb"), each.alias("pa"), F.col("own").alias("pb"))
    return a.join(b, [*keys, "pa", "pb"]).where("sa < sb").select("sa", "sb")


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """(same, doc_id) of all documents long enough to share a span."""
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= length)).select(F.unhex(F.md5("text")).alias("same"), "doc_id").distinct()


def members_to_pair(members: DataFrame, group: str, member: str, most: int | None = None) -> DataFrame:
    """Members of groups of exact copies that stand in pairs: all, or of groups of more than ``most`` the smallest.

    A group of copies that holds a share of all rows would otherwise make pairs in proportion to the
    square of the rows, all of which say the same of one text; its membership is in the operator's tables.
    """
    most = COPIES if most is None else most
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_members"), F.min(member).alias("_first"))
    rows = members.join(sizes, group).where((F.col("_members") <= most) | (F.col(member) == F.col("_first")))
    return rows.drop("_members", "_first")


def found(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """p10_found: (doc_a, doc_b) of all documents that share ``length`` code points verbatim.

    Copies of one text share all of it; of more than ``COPIES`` copies, each is paired with the smallest
    doc_id, which alone stands in the pairs with other texts. Null texts and texts shorter than ``length`` have no pairs;
    a doc_id delivered twice with the same text counts once.
    """
    members = materialize(_copies(docs, length))
    links = materialize(Shared(occurrences(docs, length), length).links())
    linked = links.select(F.col("sa").alias("same")).union(links.select(F.col("sb").alias("same"))).distinct()
    few = members_to_pair(members.join(linked, "same", "left_semi"), "same", "doc_id")
    a, b = few.select(F.col("same").alias("sa"), F.col("doc_id").alias("x")), few.select(F.col("same").alias("sb"), F.col("doc_id").alias("y"))
    across = links.join(a, "sa").join(b, "sb").select("x", "y")
    many = members.groupBy("same").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("first")).where("k > 1")
    alike = members.join(many, "same")
    star = alike.where((F.col("k") > COPIES) & (F.col("doc_id") != F.col("first"))).select(F.col("first").alias("x"), F.col("doc_id").alias("y"))
    alike = alike.where(F.col("k") <= COPIES)
    within = alike.select("same", F.col("doc_id").alias("x")).join(alike.select("same", F.col("doc_id").alias("y")), "same").where("x < y").select("x", "y").union(star)
    both = across.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return both.union(within.select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))).distinct()


def shared_share(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document is shared with another.

    Every document with an id comes out once; null and short texts share nothing. Overlapping spans
    count once. The spans of a document are united from their starts and ends in order, a window over
    the document's own spans only.
    """
    from pyspark.sql import Window as W

    ends = Shared(occurrences(docs, length), length).covered().groupBy("same", "p").agg(F.max("e").alias("e"))
    before = F.max("e").over(W.partitionBy("same").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    cover = ends.withColumn("b", before).withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("p", F.coalesce("b", F.lit(0)))))
    cover = cover.groupBy("same").agg(F.sum("new").alias("c"))
    per_doc = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.unhex(F.md5("text")).alias("same"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).dropDuplicates(["doc_id"])
    copies = per_doc.where(F.col("n_chars") >= length).groupBy("same").agg(F.count(F.lit(1)).alias("k"))
    got = per_doc.join(copies, "same", "left").join(cover, "same", "left")
    shared = F.when(F.col("k") > 1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("long")
    return got.select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)), 6).alias("share"))


def members(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, first_id, copies): the text of each document that can share a span, and who else has it.

    ``first_id`` is the smallest doc_id of the text, which stands for it in the pairs of ``found`` where its copies are
    more than ``COPIES``; with this table every pair of documents can be told from those.
    """
    rows = _copies(docs, length)
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(groups, "same").select("doc_id", F.lower(F.hex("same")).alias("text_key"), "first_id", "copies")
