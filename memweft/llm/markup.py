"""Markup residue: a linear-chain CRF over the leaf blocks of a page tells markup from content.

``leaves`` parses a text tolerantly, in time in proportion to its length, into leaf blocks: runs of text, and spans
that could be HTML, Markdown, wiki or LaTeX markup, each with the constructs it stands in (its path of ancestors:
HTML elements, a wiki table, TeX environments ...). Blocks that hold text of their own, such as templates, emphasis
and commands, are read again inside, to any depth that Python can (``DEEP``). Most candidates are ambiguous on their own: ``#`` opens
a Markdown heading or a wiki list item, ``$5 ... $7`` is money or a formula, ``List<T>`` is no tag. The CRF
weighs ancestor-tag and text features of each leaf and the labels of its neighbours, and Viterbi
decoding labels every leaf ``text``, ``code``, ``html``, ``markdown``, ``wiki`` or ``latex``. ``clean`` then
renders the page from the labelled leaves, and the kinds that occur are those of its markup leaves.

The CRF is trained here on labelled pages: ``labelled_pages`` composes pages from constructs of each
kind and from prose with look-alikes, where every leaf's label is known.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["html", "markdown", "wiki", "latex"]
LABELS = ["text", "code", *KINDS]

# HTML element names.
TAGS = set(
    "a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript nowiki ol option p pre q ref s samp script section select small source span strike strong style sub summary sup syntaxhighlight table tbody td textarea tfoot th thead time title tr tt u ul var video math gallery".split()
)
RAW = {"pre", "code", "script", "style", "nowiki", "syntaxhighlight", "source", "math", "tt", "kbd", "samp"}
#: TeX environments whose content is a formula, and such as hold code.
FORMULAS = {"equation", "align", "gather", "multline", "eqnarray", "displaymath", "math"}
LISTINGS = {"verbatim", "lstlisting", "minted"}

_TRIGGER = re.compile(r"[\n<&\\$*_~`\[{|'!}]")
_LINE = re.compile(
    r"\n[ \t]*(?:"
    r"(?P<quote>(?:>[ \t]?)+)?(?:"
    r"(?P<fence>`{3,}|~{3,})(?P<info>[^\n`]*)(?=\n|\Z)"
    r"|(?P<eqhead>={1,6})[ \t]*(?P<eqtitle>[^=\n]+?)[ \t]*(?P=eqhead)[ \t]*(?=\n|\Z)"
    r"|(?P<rule>={3,}|-{3,}|\*{3,}|_{3,})[ \t]*(?=\n|\Z)"
    r"|(?P<hash>#{1,6})[ \t]+"
    r"|(?P<bullet>[-+]|\*{1,4})[ \t]+(?P<task>\[[ xX]\][ \t]+)?"
    r"|(?P<num>\d{1,3}[.)])[ \t]+(?P<task2>\[[ xX]\][ \t]+)?"
    r"|(?P<wlist>[*#:;]{2,6}|[:;])(?=[ \t])"
    r"|(?P<topen>\{\|[^\n]*)"
    r"|(?P<mdrule>\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?)[ \t]*(?=\n|\Z)"
    r"|(?P<tctl>\|[-}+][^\n|<]*)"
    r"|(?P<cell>[|!])(?=[ \t]|[^\s|])"
    r")?)"
)
_AT = {
    "<": re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s+[^<>]*|\s*)?)(?P<self>/?)>", re.S),
    "&": re.compile(r"&(?:(?P<named>[A-Za-z][A-Za-z0-9]{1,30})|#(?P<dec>\d{1,7})|#[xX](?P<hex>[0-9A-Fa-f]{1,6}));"),
    "\\": re.compile(r"\\(?:begin\{(?P<begin>\w+\*?)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?|end\{(?P<end>\w+\*?)\}|\[(?P<disp>.+?)\\\]|\((?P<inl>[^\n]+?)\\\)|(?P<cmd>[A-Za-z]+)(?P<star>\*?)(?P<opt>\[[^\[\]\n]*\])?|(?P<esc>[%&$#_{}~^\\]))", re.S),
    "$": re.compile(r"\$\$(?P<disp>.+?)\$\$|\$(?P<inl>[^$\n]+)\$", re.S),
    "*": re.compile(r"(?P<run>\*{1,3})(?=\S)(?P<body>[^*\n]+?)(?<=\S)(?P=run)"),
    "_": re.compile(r"(?P<run>_{1,3})(?=\S)(?P<body>[^_\n]+?)(?<=\S)(?P=run)(?![^\W_])"),
    "~": re.compile(r"~~(?=\S)(?P<body>[^~\n]+?)(?<=\S)~~|~(?=\\)"),
    "`": re.compile(r"(?P<run>`{1,3})(?P<body>[^`\n]+)(?P=run)"),
    "[": re.compile(r"\[\[(?P<wiki>[^\[\]\n]++)\]\]|\[(?P<body>[^\[\]\n]*+)\](?:\((?P<url>[^()\s]++)(?:\s+\"[^\"\n]*\")?\)|\[(?P<refid>[^\[\]\n]*+)\])|\[(?P<ext>(?:https?:)?//[^\s\]]+)(?:[ \t]+(?P<extlabel>[^\[\]\n]*))?\]|\[(?P<plain>[^\[\]\n]+)\]"),
    "!": re.compile(r"!\[(?P<body>[^\[\]\n]*+)\]\((?P<url>[^()\s]++)(?:\s+\"[^\"\n]*\")?\)|!!"),
    "{": re.compile(r"\{\{(?P<tpl>[^{}\n]++)\}\}"),
    "|": re.compile(r"\|\||\|(?=[ \t\n]|\Z)|\|\}"),
    "'": re.compile(r"(?P<run>'{2,5})(?=[^'\s])(?P<body>[^'\n]++(?:'(?!')[^'\n]*)*?)(?P=run)"),
}


class Leaf:
    """A leaf block: its type, its place in the text, its observations and what rendering needs."""

    __slots__ = ("type", "start", "end", "obs", "info")

    def __init__(self, type, start, end, obs="", info=None):
        self.type, self.start, self.end, self.obs, self.info = type, start, end, obs, info


def _mathy(s: str) -> str:
    return "tex" if "\\" in s else "script" if re.search(r"[\^_]", s) else "rel" if re.search(r"[=+<>]", s) else "money" if s[:1].isdigit() else "word"


_FIRST = re.compile(r"\s*(\S)")
_INNER_CODE = re.compile(r"\s*<code[^<>]*>")


def _matches(text: str, opening: str, closing: str) -> dict[int, int]:
    """Where the bracket that opens at each place closes; brackets without a partner are left out."""
    if opening * 2 not in text and opening == "[":
        return {}
    out, stack = {}, []
    for m in re.finditer(re.escape(opening) + "|" + re.escape(closing), text):
        if m[0] == opening:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def leaves(text: str) -> list[Leaf]:
    """The leaf blocks of a text in order; together they cover it."""
    out: list[Leaf] = []
    stack: list[str] = []  # open HTML elements
    opens: Counter[str] = Counter()
    envs: list[str] = []
    braces = _matches(text, "{", "}") if "{" in text else {}
    squares = _matches(text, "[", "]")
    closes: dict[str, list[int]] = {}  # closing tags by name
    if "</" in text:
        for m in re.finditer(r"</([A-Za-z][A-Za-z0-9]*)", text):
            closes.setdefault(m[1].lower(), []).append(m.start())

    def closed_at(tag: str, at: int) -> int:
        where = closes.get(tag, ())
        i = bisect_left(where, at)
        return where[i] if i < len(where) else -1

    table = ""
    pos = start = 0
    n = len(text)

    found_at: dict[str, int] = {}

    def ahead(mark: str, at: int, none: int = -1) -> int:
        """Where ``mark`` next stands at or after ``at``; each stretch of the text is searched once."""
        last = found_at.get(mark, -2)
        if last != -1 and last < at:
            last = found_at[mark] = text.find(mark, at)
        return none if last == -1 else last

    row_at = scanned = 0

    def head(at: int) -> str:
        """The first character that isn't blank in the line of ``at``, if it stands before it; lines are looked for once."""
        nonlocal row_at, scanned
        row_at, scanned = max(row_at, text.rfind("\n", scanned, at) + 1), at
        m = _FIRST.match(text, row_at, at)
        return m[1] if m else ""

    def push(leaf: Leaf) -> None:
        nonlocal start
        if leaf.start > start:
            out.append(Leaf("text", start, leaf.start))
        anc = "math" if envs and envs[-1].rstrip("*") in FORMULAS else "env" if envs else table or (stack[-1] if stack else "")
        if anc:
            path = [*stack[-3:], *([table] if table else []), *envs[-3:]][-3:]
            leaf.obs += f"|^{anc}|^^{'>'.join(path)}"
        before = text[leaf.start - 1 : leaf.start]
        if leaf.type not in _LINED and before and (before.isalnum() or before == "_"):
            leaf.obs += "|glued"
        out.append(leaf)
        start = leaf.end

    while True:
        hit = _TRIGGER.search(text, pos)
        if hit is None:
            break
        p = hit.start()
        c = text[p]
        if c == "\n":
            m = _LINE.match(text, p)
            pos = max(m.end(), p + 1)
            if m.end() == p + 1 or m.lastgroup is None:
                continue
            q = m["quote"]
            at = p
            if q:
                push(Leaf("quote", at, m.end("quote"), "q"))
                at = m.end("quote")
            if m["fence"]:
                close = re.compile(r"\n[ \t>]*" + re.escape(m["fence"]) + r"[ \t]*(?=\n|\Z)").search(text, m.end())
                stop = close.start() if close else n
                push(Leaf("fence", at, m.end(), "open", m["info"].strip()))
                if stop > m.end():
                    push(Leaf("raw", m.end(), stop, "in=fence"))
                if close:
                    push(Leaf("fence", stop, close.end(), "close"))
                pos = close.end() if close else n
            elif m["eqhead"]:
                push(Leaf("eqhead", at, m.end(), "two" if len(m["eqhead"]) > 1 else "one", (len(m["eqhead"]), m["eqtitle"])))
            elif m["rule"]:
                prev = text[text.rfind("\n", 0, p) + 1 : p].strip()
                push(Leaf("rule", at, m.end(), ("under" if prev else "alone") + m["rule"][0], m["rule"][0]))
            elif m["hash"]:
                end = text.find("\n", m.end())
                end = n if end < 0 else end
                alone = not text[end + 1 : end + 2].strip() and not text[max(0, at - 1) : at].strip()
                push(Leaf("hash", at, m.end(), f"n{min(2, len(m['hash']))}" + ("|alone" if alone else "") + ("|stop" if text[end - 1] in ".!?;" else ""), len(m["hash"])))
            elif m["bullet"]:
                push(Leaf("bullet", at, m.end(), ("*" if m["bullet"][0] == "*" else m["bullet"]) + ("task" if m["task"] else "") + str(min(2, len(m["bullet"]))) + ("|indented" if text[p + 1 : p + 2] in (" ", "\t") else "")))
            elif m["num"]:
                push(Leaf("num", at, m.end(), "task" if m["task2"] else "", m["num"]))
            elif m["wlist"]:
                push(Leaf("wlist", at, m.end(), m["wlist"][0] + ("s" if len(m["wlist"]) > 1 else "")))
            elif m["topen"]:
                table = "wtable"
                push(Leaf("topen", at, m.end(), "open"))
            elif m["tctl"]:
                push(Leaf("tctl", at, m.end(), m["tctl"][1]))
                if m["tctl"][1] == "}":
                    table = ""
            elif m["mdrule"]:
                push(Leaf("mdrule", at, m.end(), "bars" if "|" in m["mdrule"] else ""))
            elif m["cell"]:
                line_end = text.find("\n", m.end())
                line = text[m.end() : line_end if line_end >= 0 else n].rstrip()
                push(Leaf("cell", at, m.end(), m["cell"] + ("closed" if line.endswith("|") else "")))
            continue
        # without a closing mark the scan for it would run to the end of the text from each opening one
        open_ended = c == "\\" and (text[p + 1 : p + 2] == "[" and not 0 <= p + 3 <= ahead("\\]", p + 3) or text[p + 1 : p + 2] == "(" and not p + 3 <= ahead("\\)", p + 3) < ahead("\n", p + 3, n))
        m = _AT[c].match(text, p) if c in _AT and not open_ended else None
        pair = braces if c == "{" else squares
        if m is None and c in "{[" and p + 1 in pair and pair.get(p, -1) == pair[p + 1] + 1:
            # with others inside, or over several lines
            body, pos = text[p + 2 : pair[p + 1]], pair[p] + 1
            push(Leaf("template", p, pos, "args" if "|" in body else "bare", body) if c == "{" else Leaf("wlink", p, pos, "pipe" if "|" in body else "bare", body))
            continue
        if m is None or c == "_" and text[p - 1 : p].isalnum() or m[0] == "!!" and head(p) != "!":
            pos = p + 1
            continue
        pos = m.end()
        if c == "<":
            if m["comment"] is not None:
                push(Leaf("comment", p, pos, "c"))
                continue
            tag = m["tag"].lower()
            known = tag in TAGS
            opened = opens[tag] > 0
            has_close = not m["close"] and closed_at(tag, pos) >= 0
            push(Leaf("tag", p, pos, ("known" if known else "odd") + ("/" if m["close"] else "") + (("|attrs" if "=" in m["attrs"] else "|words") if m["attrs"].strip(" \n\t/") else "") + ("|opened" if opened else "") + ("|closes" if has_close else ""), (tag, bool(m["close"]))))
            if not known:
                pos = p + 1 if not (opened or has_close) else pos
            if m["close"]:
                while opens[tag] and opened:
                    top = stack.pop()
                    opens[top] -= 1
                    if top == tag:
                        break
            elif known and not m["self"] and tag not in ("br", "hr", "img", "input", "meta", "link"):
                stack.append(tag)
                opens[tag] += 1
                if tag in RAW:
                    close = closed_at(tag, pos)
                    inner = _INNER_CODE.match(text, pos) if tag == "pre" else None
                    if inner:
                        push(Leaf("tag", pos, inner.end(), "known|closes", ("code", False)))
                        stack.append("code")
                        opens["code"] += 1
                        pos = inner.end()
                        shut = closed_at("code", pos)
                        close = shut if shut >= 0 else close
                    stop = close if close >= 0 else n
                    if stop > pos:
                        push(Leaf("raw", pos, stop, "in=" + tag))
                    pos = stop
        elif c == "&":
            push(Leaf("entity", p, pos, "named" + ("" if f"{m['named']};" in html.entities.html5 else "odd") if m["named"] else "number"))
        elif c == "\\":
            if m["begin"]:
                name = m["begin"].rstrip("*")
                push(Leaf("begin", p, pos, "env", name))
                envs.append(name)
                if name in FORMULAS or name in LISTINGS:
                    close = text.find(f"\\end{{{m['begin']}}}", pos)
                    stop = close if close >= 0 else n
                    push(Leaf("formula" if name in FORMULAS else "raw", pos, stop, "in=env", (text[pos:stop].strip(), True)))
                    pos = stop
            elif m["end"]:
                if envs:
                    envs.pop()
                push(Leaf("end", p, pos, "env", m["end"].rstrip("*")))
            elif m["disp"] is not None or m["inl"] is not None:
                body = m["disp"] or m["inl"] or ""
                push(Leaf("formula", p, pos, "bs|" + _mathy(body), (body.strip(), m["disp"] is not None)))
            elif m["cmd"]:
                path = text[p - 1 : p] == ":" or text[pos : pos + 1] in ("\\", "/")
                arg = text[pos : pos + 1] == "{" and pos in braces
                body = None
                if arg:
                    body, pos = text[pos + 1 : braces[pos]], braces[pos] + 1
                section = m["cmd"].endswith("section") or m["cmd"] in ("chapter", "title", "part")
                push(Leaf("command", p, pos, ("arg" if arg else "bare") + ("|path" if path else "") + ("|item" if m["cmd"] == "item" else "|section" if section else ""), (m["cmd"], body)))
            else:
                push(Leaf("escape", p, pos, m["esc"], m["esc"]))
        elif c == "$":
            body = m["disp"] if m["disp"] is not None else m["inl"]
            kind = _mathy(body)
            edge = "|spaced" if body != body.strip() and m["disp"] is None else ""
            long = "|words" if len(re.findall(r"(?<![\\\w])[^\W\d_]{3,}", body)) > 1 else ""
            push(Leaf("formula", p, pos, ("dd|" if m["disp"] is not None else "d|") + kind + edge + long, (body.strip(), m["disp"] is not None)))
            if long and kind in ("money", "word", "rel"):
                # too doubtful to swallow what is between
                out[-1].end = start = pos = p + 1
        elif c in "*_":
            word = text[p - 1 : p].isalnum() or text[pos : pos + 1].isalnum()
            push(Leaf("emph", p, pos, f"{c}{min(2, len(m['run']))}" + ("|inword" if word else "") + ("|odd" if not re.search(r"\w", m["body"]) else ""), m["body"]))
        elif c == "~":
            push(Leaf("strike", p, pos, "pair", m["body"]) if m["body"] else Leaf("tie", p, pos, "tie"))
        elif c == "`":
            push(Leaf("span", p, pos, "tick", m["body"]))
        elif c == "[":
            if m["wiki"] is not None:
                w = m["wiki"]
                code = w[:1].isspace()
                push(Leaf("wlink", p, pos, ("spaced" if code else "pipe" if "|" in w else "cat" if ":" in w else "bare"), w))
            elif m["body"] is not None:
                push(Leaf("mlink", p, pos, "url" if m["url"] else "ref", m["body"]))
            elif m["ext"]:
                push(Leaf("xlink", p, pos, "ext", m["extlabel"] or ""))
            else:
                push(Leaf("brackets", p, pos, "plain"))
        elif c == "!":
            push(Leaf("image", p, pos, "img", m["body"]) if m["body"] is not None else Leaf("cells", p, pos, "!!"))
        elif c == "{":
            push(Leaf("template", p, pos, "args" if "|" in m["tpl"] else "bare", m["tpl"]))
        elif c == "|":
            first = out[-1].type if out else ""
            push(Leaf("bars" if m[0] == "||" else "bar", p, pos, ("row" if head(p) in ("|", "!") else "mid") + ("|ctl" if first == "tctl" else ""), None))
        elif c == "'":
            push(Leaf("quotes", p, pos, f"n{min(5, len(m['run']))}", (len(m["run"]), m["body"])))
    if start < n:
        out.append(Leaf("text", start, n))
    return out


_LINED = {"quote", "fence", "eqhead", "rule", "hash", "bullet", "num", "wlist", "topen", "tctl", "mdrule", "cell", "raw"}
#: Leaf types that only one kind of markup has; used as evidence on the page, not as a decision.
_TELLS = {"wlink": "W", "template": "W", "quotes": "W", "topen": "W", "tctl": "W", "eqhead": "W", "fence": "M", "mlink": "M", "mdrule": "M", "begin": "L"}


#: Leaf types that hold text of their own.
_HOLDERS = {"emph", "strike", "mlink", "image", "xlink", "quotes", "eqhead", "command", "wlink", "template"}


def _tells(page: list[Leaf], outer: str = "") -> str:
    return "".join(sorted({*outer, *(_TELLS[x.type] for x in page if x.type in _TELLS and x.obs[:6] != "spaced")}))


def signature(page: list[Leaf], outer: str = "") -> tuple[str, ...]:
    """What the CRF sees of a page: one string for each leaf, with its neighbours' types and the page's tells.

    ``outer`` are the tells of the page around, where this is what stands inside a leaf.
    """
    tells = _tells(page, outer)
    marks = [x for x in page if x.type not in _MUTE]
    return tuple(
        "text" if x.type == "text" else f"{x.type}|{x.obs}" + (f"|page={tells}" if x.type in _SHARED else "") + (f"|prev={_near(marks, i - 1)}|next={_near(marks, i + 1)}" if x.type in _SHARED else "")
        for x, i in zip(page, _ordinals(page))
    )


#: Types whose look several kinds share, so that neighbours matter.
_SHARED = {"hash", "bullet", "num", "wlist", "cell", "bar", "bars", "rule", "eqhead", "cells"}


#: Types that say nothing to their neighbours.
_MUTE = {"text", "brackets", "escape", "tie", "entity"}


def _ordinals(page: list[Leaf]):
    """For each leaf that has a say, which of these it is."""
    i = -1
    for x in page:
        i += x.type not in _MUTE
        yield i


def _near(marks: list[Leaf], i: int) -> str:
    return marks[i].type if 0 <= i < len(marks) else "edge"


def _features(sig: str) -> list[str]:
    kind, *rest = sig.split("|")
    return [kind, *(f"{kind}:{r}" for r in rest), f"{kind}::{'|'.join(r for r in rest if not r.startswith(('page=', 'prev=', 'next=')))}"]


class Crf:
    """Linear-chain CRF: emission weights by feature, transition weights by pair of labels."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(LABELS)))
        self.trans = np.zeros((len(LABELS), len(LABELS)))
        self.start = np.zeros(len(LABELS))

    def ids(self, sig: str) -> list[int]:
        return [self.index[f] for f in _features(sig) if f in self.index]

    def scores(self, sigs) -> np.ndarray:
        return np.array([self.emit[self.ids(s)].sum(0) for s in sigs])

    def train(self, pages, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Crf:
        """AdaGrad on the conditional log likelihood of the labelled pages [(signatures, labels)]."""
        for sigs, _ in pages:
            for s in sigs:
                for f in _features(s):
                    self.index.setdefault(f, len(self.index))
        k = len(LABELS)
        self.emit = np.zeros((len(self.index), k))
        g2 = [np.full_like(self.emit, 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)]
        rng = random.Random(seed)
        data = [([self.ids(s) for s in sigs], np.array([LABELS.index(y) for y in ys])) for sigs, ys in pages if sigs]
        for _ in range(epochs):
            rng.shuffle(data)
            for feats, y in data:
                e = np.array([self.emit[f].sum(0) for f in feats])
                t = len(e)
                a = np.empty_like(e)
                a[0] = self.start + e[0]
                for i in range(1, t):
                    x = a[i - 1][:, None] + self.trans
                    m = x.max(0)
                    a[i] = e[i] + m + np.log(np.exp(x - m).sum(0))
                b = np.zeros_like(e)
                for i in range(t - 2, -1, -1):
                    x = self.trans + (e[i + 1] + b[i + 1])[None, :]
                    m = x.max(1)
                    b[i] = m + np.log(np.exp(x - m[:, None]).sum(1))
                z = np.logaddexp.reduce(a[-1])
                d = np.exp(a + b - z)  # d: marginals, then their difference to the truth
                dt = np.zeros((k, k))
                for i in range(1, t):
                    dt += np.exp(a[i - 1][:, None] + self.trans + (e[i] + b[i])[None, :] - z)
                    dt[y[i - 1], y[i]] -= 1
                d[np.arange(t), y] -= 1
                for f, row in zip(feats, d):
                    g = row[None, :] + decay * self.emit[f]
                    g2[0][f] += g**2
                    self.emit[f] -= rate * g / np.sqrt(g2[0][f])
                for w, g, s in ((self.trans, dt + decay * self.trans, 1), (self.start, d[0] + decay * self.start, 2)):
                    g2[s] += g**2
                    w -= rate * g / np.sqrt(g2[s])
        return self

    def decode(self, sigs) -> list[str]:
        """Viterbi: the most probable labels of a page's leaves."""
        if not sigs:
            return []
        e = self.scores(sigs)
        best, back = self.start + e[0], []
        for row in e[1:]:
            x = best[:, None] + self.trans
            back.append(x.argmax(0))
            best = x.max(0) + row
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return [LABELS[i] for i in reversed(y)]


# --- labelled pages ------------------------------------------------------------------------------
_NOUNS = "river stone letter market engine garden window bottle camera forest bridge island pocket mirror basket candle ladder saddle violin harbor".split()
_VERBS = "moves keeps finds checks paints builds opens sends counts turns".split()


def labelled_pages(n: int = 1000, seed: int = 11):
    """(text, labels of its leaves): composed pages, in part of one kind of markup, in part mixed.

    The composer marks each piece with its label; a leaf has the label of the piece it starts in.
    """
    rng = random.Random(seed)
    w = lambda: rng.choice(_NOUNS)
    num = lambda: rng.randint(2, 9999)

    def sentence():
        return f"The {w()} {rng.choice(_VERBS)} {num()} {w()}s near the {w()}."

    def lookalike():
        """Prose with characters that markup uses too: each kind of use once, in words of no particular text."""
        n, v = num(), rng.choice(_VERBS)
        ops = rng.choice(["&&", "||", "*", "^", "<", ">", "<=", "->", "|", "~", "==", "+="])
        use = rng.choice([
            lambda: f"#{n}", lambda: f"{rng.choice('CFJ')}#", lambda: f"[{w()}]", lambda: f"[{rng.randint(1, 99)}]", lambda: f"${n}", lambda: f"${n} or ${num()}", lambda: f"US${n}, ${num()} and ${num()}",
            lambda: f"{w()} {ops} {w()}", lambda: f"{n} {ops} {num()}", lambda: f"{n} * {num()} * {num()}", lambda: f"{rng.choice('QABX')}&{rng.choice('ABTX')}", lambda: f"{rng.choice('QABX')}&{rng.choice('ABT')};", lambda: f"{w()}&{w()};", lambda: f"${w().upper()} or ${{{w().upper()}}}/{w()}", lambda: f'"${w().upper()}/{w()}" = ${n}',
            lambda: f"{rng.choice('CDEX')}:\\{w()}\\{w()}", lambda: f"{rng.choice('CDEX')}:\\{w()}\\{w()}\\{w()}.txt", lambda: f"\\\\{w()}\\{w()}", lambda: f"~{n}", lambda: f"~/{w()}/{w()}", lambda: f"{rng.randint(1, 99)}%",
            lambda: f"{rng.choice(['List', 'Set', 'Promise', 'vector'])}<{w().title()}>", lambda: f"Map<{w().title()}, {w().title()}>", lambda: f"{{{w()}}}", lambda: f"{w()}_{w()}_{w()}", lambda: f"__{w()}", lambda: f"{w()}_{n}_{num()}", lambda: f"{w()}*",
            lambda: f"{w()}s/{w()}_{n}.md", lambda: f"{w()}[{rng.randint(0, 9)}]", lambda: f"f(*{w()}s, **{w()}s)", lambda: f"{w()}'s and {w()}s'", lambda: f"'{w()}'", lambda: f"`{w()}", lambda: f"a <{w()} and {w()}>", lambda: f"-{n}", lambda: f"{n}:{num()}",
        ])
        return f"{rng.choice(['Some', 'Every', 'One', 'No'])} {w()} {v} {use()} {rng.choice(['before', 'with', 'over'])} the {w()}{rng.choice(['', f' ({use()})', f', {use()}'])}."

    def prose(k):
        return [(" ".join(lookalike() if rng.random() < 0.3 else sentence() for _ in range(k)), "text")]

    def code_line():
        return rng.choice([f"select {w()}_id, count(*) from {w()}_{w()} group by 1;", f'<div id="{w()}">{w()} {num()}</div>', f'echo "${w()}" | sort -u > {w()}.txt', f"if [[ -f /tmp/{w()} ]]; then rm -r {w()}_{num()}; fi", f"# {w()} {num()}", f"{w()}: {{ size: {num()}, mode: {w()} }}", f"def f_{w()}(x, *args): return x[{num()}] * {num()}", f"- {w()} == **{w()}** && \\{w()}{{x}} $a$", f"[{w()}]({w()}) {{{{{w()}}}}} [[{w()}]] &amp;"])

    def code(k):
        return "\n".join(code_line() for _ in range(k))

    def math():
        return rng.choice([f"x^{num()} \\leq \\alpha y", f"\\frac{{a_{num()}}}{{b + {num()}}}", "e^{-\\lambda t} \\cdot 3", f"\\sum_{{i=1}}^{{n}} k_i^{num()}", "a = b + c", f"y_{{{num()}}}", "n", "x^2", "\\sqrt{n}", "E = mc^2"])

    def inline(kind):
        if kind == "html":
            t = rng.choice(["b", "i", "em", "strong", "span", "a", "code", "sub"])
            return rng.choice([[(f"<{t}>", "html"), (f"{w()} {num()}", "code" if t == "code" else "text"), (f"</{t}>", "html")], [("<br>", "html")], [("<br/>", "html")], [("<br />", "html")], [(rng.choice(["&nbsp;", "&amp;", "&lt;", "&#8217;", "&#x2014;", "&quot;", "&amp;amp;"]), "html")], [(f"<a href='/{w()}?id={num()}'>", "html"), (w(), "text"), ("</a>", "html")], [(f"<!-- {w()} {num()} -->", "html")]])
        if kind == "markdown":
            return [(rng.choice([f"**{w()}**", f"*{w()}*", f"__{w()}__", f"_{w()}_", f"~~{w()}~~", f"`{w()}`", f"`{w()}_{num()} == 1`", f"[{w()}](https://{w()}.example/{num()} \"{w()}\")", f"[{w()}]({w()}s/{w()}.md)", f"![{w()}](img/{w()}.png)", f"***{w()} {w()}***", f"[{w()}][{num()}]"]), "markdown")]
        if kind == "wiki":
            return [(rng.choice([f"[[{w().title()}|{w()}]]", f"[[{w().title()}]]", f"'''{w()} {w()}'''", f"''{w()} {num()} {w()}''", f"{{{{cite|{w()}={num()}}}}}", f"{{{{{w()}}}}}", f"[[Category:{w()} {num()}]]", f"[https://{w()}.example/{num()} {w()}]"]), "wiki")]
        return rng.choice([[(f"\\{rng.choice(['textbf', 'emph', 'textit', 'texttt', 'footnote', 'underline'])}{{{w()}}}", "latex")], [("~", "latex"), (f"\\cite{{{w()}{num()}}}", "latex")], [(f"${math()}$", "latex")], [(f"\\({math()}\\)", "latex")], [("\\LaTeX", "latex")], [(f"\\ref{{{w()}}}", "latex")]])

    def rich(kind, k=2):
        out = []
        for _ in range(k):
            out += prose(1)
            out += [(" ", "text"), *inline(kind), (" ", "text")] if kind and rng.random() < 0.5 else [(" ", "text")]
        return out + prose(1)

    def block(kind):
        title = f"{w().title()} {w()} {num()}"
        lines = rng.randint(1, 5)
        if kind == "html":
            return rng.choice([
                [("<p>", "html"), *rich(kind), ("</p>", "html")],
                [(f'<div class="{w()}">', "html"), ("<h2>", "html"), (title, "text"), (rng.choice(["</h2>", "</h3>"]), "html"), ("</div>", "html")],
                [("<ul>", "html"), *[x for _ in range(lines) for x in [("<li>", "html"), *rich(kind, 1), *([("</li>", "html")] if rng.random() < 0.6 else [])]], ("</ul>", "html")],
                [("<table border=0>", "html"), *[x for _ in range(lines) for x in [("<tr>", "html"), ("<td>", "html"), (title, "text"), ("</td>", "html"), ("<td>", "html"), *prose(1), ("</td>", "html"), ("</tr>", "html")]], ("</table>", "html")],
                [("<pre>", "html"), ("<code>", "html"), (code(lines), "code"), ("</code>", "html"), ("</pre>", "html")],
                [("<style>", "html"), (f".{w()} {{ margin: {num()}px }}", "code"), ("</style>", "html"), ("<span>", "html"), *prose(1), ("</span>", "html")],
                [("<details>", "html"), ("<summary>", "html"), (title, "text"), ("</summary>", "html"), ("\n\n", "text"), *prose(2), ("\n\n", "text"), ("</details>", "html")],
                [(f"<!-- {title} -->", "html")],
                [("<details>", "html"), ("<summary>", "html"), (title, "text"), ("</summary>", "html"), ("\n\n", "text"), *rich("markdown", 2), ("\n\n", "text"), ("</details>", "html")],
            ])
        if kind == "markdown":
            mark = rng.choice(["- ", "* ", "* ", "+ ", "- [ ] ", "- [x] ", "n", ")"])
            head = lambda i: f"{i + 1}. " if mark == "n" else f"{i + 1}) " if mark == ")" else mark
            f = rng.choice(["```", "~~~"])
            return rng.choice([
                [("\n" + "#" * rng.randint(1, 4) + " ", "markdown"), (title, "text")],
                [x for i in range(lines) for x in [("\n" + head(i), "markdown"), *rich(kind, 1)]],
                [x for i in range(lines + 1) for x in [("\n" + "  " * rng.choice([0, 0, 1]) + head(i), "markdown"), *rich(kind, 1)]],
                [x for _ in range(lines) for x in [("\n> ", "markdown"), *rich(kind, 1)]],
                [("\n" + f + rng.choice(["", "python", "sql", "bash"]), "markdown"), ("\n" + code(lines), "code"), ("\n" + f, "markdown")],
                [("\n" + title, "text"), ("\n" + rng.choice(["=====", "-----"]), "markdown")],
                [("\n|", "markdown"), (f" {w()} ", "text"), ("|", "markdown"), (f" {w()} ", "text"), ("|", "markdown"), ("\n|---|:--:|", "markdown"), *[x for _ in range(lines) for x in [("\n|", "markdown"), (f" {w()} ", "text"), ("|", "markdown"), (f" {num()} ", "text"), ("|", "markdown")]]],
                [("\n", "text"), *rich(kind, 3)],
            ])
        if kind == "wiki":
            mark = rng.choice(["* ", "# ", "** ", ": "])
            level = "=" * rng.randint(2, 4)
            return rng.choice([
                [(f"\n{level} {title} {level}", "wiki")],
                [x for _ in range(lines) for x in [("\n" + mark, "wiki"), *rich(kind, 1)]],
                [('\n{| class="plain"', "wiki"), ("\n!", "wiki"), (f" {w()} ", "text"), ("!!", "wiki"), (f" {w()} ", "text"), ("\n|-", "wiki"), *[x for _ in range(lines) for x in [("\n|", "wiki"), (f" {w()} ", "text"), ("||", "wiki"), *prose(1), ("\n|-", "wiki")]], ("\n|", "wiki"), (f" {w()} ", "text"), ("||", "wiki"), *prose(1), ("\n|}", "wiki")],
                [(f"{{{{infobox|owner={w()}|size={num()}}}}}", "wiki"), ("\n", "text"), *prose(2)],
                [("\n", "text"), *rich(kind, 3)],
            ])
        return rng.choice([
            [(f"\\section{{{title}}}", "latex"), ("\n", "text"), *prose(2)],
            [("\\begin{itemize}", "latex"), *[x for _ in range(lines) for x in [("\n", "text"), ("\\item", "latex"), (" ", "text"), *rich(kind, 1)]], ("\n", "text"), ("\\end{itemize}", "latex")],
            [("\\begin{equation}", "latex"), (f"\n{math()}\n", "latex"), ("\\end{equation}", "latex")],
            [(f"$$ {math()} $$", "latex")], [(f"\\[ {math()} \\]", "latex")],
            [("\n", "text"), *rich(kind, 3)],
        ])

    pages = []
    for _ in range(n):
        kinds = rng.choice([[], ["html"], ["markdown"], ["markdown"], ["wiki"], ["wiki"], ["latex"], ["markdown", "html"], ["wiki", "html"], ["latex", "html"], ["markdown", "latex"]])
        pieces = [("\n", "text")]
        main = kinds[0] if kinds else None
        for _ in range(rng.randint(1, 4)):
            pieces += (block(main) if main and rng.random() < 0.75 else prose(rng.randint(1, 3))) + [("\n\n", "text")]
            for other in kinds[1:]:
                pieces += [(" ", "text"), *inline(other), (" ", "text")] if rng.random() < 0.7 else block(other) + [("\n\n", "text")]
        text, owner = "", []
        for s, y in pieces:
            owner += [y] * len(s)
            text += s
        page = leaves(text)
        # a leaf that starts with the newline before its mark belongs to the mark
        labels = [_majority(owner[x.start : x.end]) if x.type != "text" else "text" for x in page]
        pages.append((signature(page), labels))
    return pages


def _majority(owners: list[str]) -> str:
    kinds = [y for y in owners if y in KINDS]
    return max(set(kinds or owners), key=(kinds or owners).count)


@cache
def trained(n: int = 1000) -> Crf:
    """The CRF trained on ``n`` labelled pages; once per process."""
    return Crf().train(labelled_pages(n))


# --- rendering -----------------------------------------------------------------------------------
#: How deep blocks inside blocks are read; what lies deeper is kept as written. Labels of pages that are kept for reuse.
DEEP, MEMO = 40, 500_000


class Reading:
    """A labelled page: its leaves, their labels, the text, and the readings of what stands inside its leaves."""

    __slots__ = ("page", "labels", "text", "inner")

    def __init__(self, page, labels, text, inner):
        self.page, self.labels, self.text, self.inner = page, labels, text, inner

    def __iter__(self):
        return iter((self.page, self.labels, self.text))

    def kinds(self) -> set[str]:
        out = {y for y in self.labels if y in KINDS}
        for parts in self.inner.values():
            for part in parts:
                if isinstance(part, Reading):
                    out |= part.kinds()
        return out


def _bodies(leaf: Leaf) -> list[str]:
    """The texts that stand inside a leaf."""
    x = leaf.info
    if leaf.type in ("emph", "strike", "mlink", "image", "xlink"):
        return [x]
    if leaf.type in ("quotes", "eqhead"):
        return [x[1]]
    if leaf.type == "command":
        return [x[1]] if x[1] else []
    if leaf.type == "wlink":
        return [_split(x)[-1]]
    if leaf.type == "template":
        return [v for _, v in _arguments(x)]
    return []


def _split(body: str) -> list[str]:
    """The parts of a template or link between its own bars, not those of others inside it."""
    depth, start, out = 0, 0, []
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", body):
        if m[0] == "|":
            if depth <= 0:
                out.append(body[start : m.start()])
                start = m.end()
        else:
            depth += 1 if m[0] in ("{{", "[[") else -1
    return [*out, body[start:]]


def _arguments(body: str) -> list[tuple[str, str]]:
    """(name or "", value) of a template's arguments."""
    out = []
    for part in _split(body)[1:]:
        m = re.match(r"\s*([\w \-]+?)\s*=", part)
        out.append((m[1], part[m.end() :]) if m else ("", part))
    return out


class Reader:
    """Decodes pages with memoised labels: pages of one shape are decoded once."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.held = crf, {}, 0

    def labels(self, sig: tuple[str, ...]) -> tuple[str, ...]:
        got = self.known.get(sig)
        if got is None:
            got = tuple(self.crf.decode(sig))
            if self.held > MEMO:  # in leaves, so that long pages count for what they take
                self.known, self.held = {}, 0
            self.known[sig] = got
            self.held += len(sig)
        return got

    def read(self, text: str) -> Reading:
        return self._read("\n" + text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff"), "", 0)

    def _read(self, t: str, tells: str, depth: int) -> Reading:
        page = leaves(t)
        own = _tells(page, tells)
        labels = self.labels(signature(page, tells))
        inner = {}
        if depth < DEEP:
            for i, (x, y) in enumerate(zip(page, labels)):
                if y in KINDS and x.type in _HOLDERS:
                    bodies = _bodies(x)
                    if any(map(_TRIGGER.search, bodies)):
                        inner[i] = [self._read(b, own, depth + 1) if _TRIGGER.search(b) else b for b in bodies]
        return Reading(page, labels, t, inner)


def clean(reading: Reading) -> tuple[str, dict[str, int]]:
    """Plain text of a labelled page, and how many headings, items, code blocks, tables and formulas it shows.

    Headings stand on lines of their own after ``§`` signs by level, list items after ``•`` (or their
    number), code keeps its lines indented by four blanks, table cells are separated by tabs, and
    formulas are kept as written between ``⟦`` and ``⟧``. Comments, style sheets and scripts go.
    """
    n = dict.fromkeys(("headings", "items", "code_blocks", "tables", "formulas"), 0)
    t = _rendered(reading, n)
    t = re.sub(r"[ \t]+\n", "\n", t)
    t = re.sub(r"(?m)^(•|§+) +", r"\1 ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip(), n


def _rendered(reading: Reading, n: dict[str, int]) -> str:
    out: list[str] = []
    page, labels, text = reading
    for at, (x, y) in enumerate(zip(page, labels)):
        s = text[x.start : x.end]
        kind = x.type
        inside = [_rendered(b, n) if isinstance(b, Reading) else b for b in reading.inner.get(at, ())] or (_bodies(x) if kind in _HOLDERS else [])
        if y == "text":
            out.append(s)
        elif kind == "raw" or y == "code":
            if x.obs.startswith(("in=style", "in=script")):
                continue
            block = x.obs.startswith(("in=fence", "in=pre", "in=env")) or "\n" in s
            n["code_blocks"] += block
            out.append("\n\n" + "\n".join("    " + line for line in s.strip("\n").split("\n")) + "\n\n" if block else s)
        elif kind == "formula":
            body, display = x.info if x.info else (s, False)
            n["formulas"] += 1
            out.append(f"\n⟦{body}⟧\n" if display else f"⟦{body}⟧")
        elif kind == "hash":
            if y == "wiki":
                n["items"] += 1
                out.append("\n• ")
            else:
                n["headings"] += 1
                out.append("\n" + "§" * x.info + " ")
        elif kind == "eqhead":
            n["headings"] += 1
            out.append("\n" + "§" * x.info[0] + " " + inside[0])
        elif kind == "rule":
            n["headings"] += x.obs.startswith("under")
        elif kind in ("bullet", "wlist"):
            n["items"] += 1
            out.append("\n• ")
        elif kind == "num":
            n["items"] += 1
            out.append(f"\n{x.info} ")
        elif kind in ("cell", "tctl", "mdrule", "topen"):
            n["tables"] += kind in ("topen", "mdrule")
            out.append("\n" if kind in ("cell", "tctl") else "")
        elif kind in ("bar", "bars", "cells"):
            out.append("\t")
        elif kind == "tag":
            tag, close = x.info
            if tag[0] == "h" and tag[1:].isdigit():
                n["headings"] += not close
                out.append("\n\n" if close else "\n\n" + "§" * int(tag[1:]) + " ")
            elif tag == "li":
                n["items"] += not close
                out.append("" if close else "\n• ")
            elif tag == "table":
                n["tables"] += not close
                out.append("\n")
            elif tag in ("td", "th"):
                out.append("\t" if close else "")
            elif tag in ("br", "p", "div", "tr", "ul", "ol", "dl", "dt", "dd", "blockquote", "section", "summary", "details", "hr", "pre"):
                out.append("\n")
        elif kind == "entity":
            out.append(html.unescape(s))
        elif kind == "span":
            out.append(x.info)
        elif kind in ("emph", "strike", "mlink", "image", "xlink", "quotes"):
            out.append(inside[0])
        elif kind == "wlink":
            out.append(inside[0] if not x.info.startswith("Category:") else "")
        elif kind == "template":
            out.append(" ".join(v.strip() for v in inside))
        elif kind == "command":
            cmd, body = x.info[0], inside[0] if inside else None
            if cmd.endswith("section") or cmd in ("chapter", "part", "title"):
                n["headings"] += 1
                out.append("\n\n" + "§" * (1 + cmd.count("sub")) + f" {body or ''}\n")
            elif cmd == "item":
                n["items"] += 1
                out.append("\n• ")
            elif cmd not in ("cite", "ref", "label", "pageref", "eqref"):
                out.append(body if body is not None else "")
        elif kind == "escape":
            out.append(x.info)
        elif kind == "tie":
            out.append(" ")
        elif kind == "quote":
            out.append("\n")
    return "".join(out)


CLEANED = "cid string, kinds array<string>, clean_text string, headings int, items int, code_blocks int, tables int, formulas int"


def convert(chunks: DataFrame, pages: int = 1000) -> DataFrame:
    """One row per delivered chunk row: its kinds of markup, its clean text and the structure it shows.

    Rows with a null cid are left out; a null text has no kinds and a null clean text; a text
    without markup comes out as it is but for outer and trailing blanks. Repeated rows of a cid repeat.
    """
    bc = chunks.sparkSession.sparkContext.broadcast(trained(pages))

    def run(batches):
        reader = Reader(bc.value)
        for pdf in batches:
            rows = []
            for cid, text in zip(pdf["cid"], pdf["text"]):
                if text is None:
                    rows.append((cid, [], None, 0, 0, 0, 0, 0))
                    continue
                reading = reader.read(text)
                got, n = clean(reading)
                rows.append((cid, sorted(reading.kinds()), got, *n.values()))
            yield pd.DataFrame(rows, columns=["cid", "kinds", "clean_text", *("headings", "items", "code_blocks", "tables", "formulas")])

    return chunks.where(F.col("cid").isNotNull()).select("cid", "text").mapInPandas(run, CLEANED)


def found(chunks: DataFrame) -> DataFrame:
    """p2_found: (cid, kind) for each kind of markup that the CRF finds in a chunk."""
    return convert(chunks).select("cid", F.explode("kinds").alias("kind")).distinct()
