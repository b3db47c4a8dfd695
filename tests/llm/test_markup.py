"""Markup residue on pages written by hand, none of them from the composer that trains the model.

The features and the composer were changed after a look at errors on ``PAGES``; ``FRESH`` was written afterwards.
"""

import time

import pytest

from memweft.llm import markup


@pytest.fixture(scope="module")
def reader():
    return markup.Reader(markup.trained())


# (page, kinds): written by hand in the manner of readmes, articles, papers, web pages and plain mail
PAGES = [
    ("# Installation\n\nRun `make all` first, then:\n\n    cd build\n\n1. Unpack the archive\n2. Read **all** of the notes\n\nSee [the guide](docs/guide.md).", {"markdown"}),
    ("Release notes\n=============\n\n* fixed a leak in `close()`\n* added ~~old~~ new flags\n\n> Thanks to everyone.", {"markdown"}),
    ("| Day | Rain |\n|-----|-----:|\n| Mon | 3 mm |\n| Tue | 0 mm |\n\nTotals are rounded.", {"markdown"}),
    ("Use a fence:\n\n```python\nx = {'a': [1, 2]}  # not a heading\nprint(x['a'])\n```\n\nDone.", {"markdown"}),
    ("Shopping:\n\n- [ ] milk\n- [x] bread\n- [ ] *ripe* pears", {"markdown"}),
    ("Setext title\n------------\n\nText with _emphasis_ and a rule below.\n\n***\n\nEnd.", {"markdown"}),
    ("![diagram](img/flow.png \"Flow\")\n\nThe flow is described in [issue 4][iss].\n\n[iss]: https://example.org/4", {"markdown"}),
    ("Read __this__ before you go; ***never*** skip it.", {"markdown"}),
    ("'''Mount Ebon''' is a [[mountain]] in [[Northland|the north]].\n\n== Geology ==\n\nIt is made of ''basalt''.<ref>{{cite book|title=Rocks|year=1999}}</ref>\n\n[[Category:Mountains]]", {"wiki", "html"}),
    ("{{Infobox settlement\n| name = Orvale\n| population = 4,310\n| area = 12.5 km\n}}\n'''Orvale''' is a village.", {"wiki"}),
    ("== See also ==\n\n* [[Lake Tarn]]\n* [[River Esk|Esk]]\n** [https://example.org Map of the river]\n", {"wiki"}),
    ('{| class="wikitable"\n! Year !! Winner\n|-\n| 1990 || Blue\n|-\n| 1991 || Red\n|}', {"wiki"}),
    ("; Term\n: its meaning in a ''short'' line\n: and another [[link]]", {"wiki"}),
    ("# first step\n# second step, see [[Help:Steps]]\n## a part of it\n", {"wiki"}),
    ("The bridge {{convert|{{age|1950}}|m|ft}} was rebuilt.", {"wiki"}),
    ("\\section{Results}\nWe find that $x^2 + y^2 = r^2$ holds~\\cite{doe99} for all \\emph{smooth} curves.\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", {"latex"}),
    ("Let \\(f\\) be continuous. Then\n\\[ \\int_0^1 f(t)\\,dt \\leq \\sup f. \\]", {"latex"}),
    ("\\begin{equation}\nE = mc^2\n\\end{equation}\nas in \\ref{eq:one}.", {"latex"}),
    ("The rate is $\\lambda_n = \\frac{1}{n}$ per second.", {"latex"}),
    ("\\textbf{Note:} do not \\underline{panic}.\\footnote{Unless \\textit{told} to.}", {"latex"}),
    ("\\documentclass{article}\n\\begin{document}\nHello.\n\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}\n\\end{document}", {"latex"}),
    ("$$\\sum_{k=1}^{n} k = \\frac{n(n+1)}{2}$$", {"latex"}),
    ("<html><body><h1>Welcome</h1><p>Opening hours: 9&ndash;17</p><ul><li>Mon</li><li>Tue</li></ul></body></html>", {"html"}),
    ("<table><tr><th>Size</th><td>10&nbsp;cm</td></tr></table>", {"html"}),
    ("First line<br>second line<br/>third &amp; last", {"html"}),
    ('<div class="note"><a href="/x?y=1">more</a> <!-- hidden --> <em>text</em></div>', {"html"}),
    ("<pre><code>for i in range(3): print(i) # **</code></pre>", {"html"}),
    ("<p>Water is H<sub>2</sub>O.</p>\n<script>if (a && b) { x[0] = '**'; }</script>", {"html"}),
    ("Caf&eacute; culture &#8212; a history", {"html"}),
    ("# Title\n\n<details><summary>More</summary>\n\nHidden *text* here.\n\n</details>", {"markdown", "html"}),
    ("The area is $\\pi r^2$.\n\n## Proof\n\n- trivial", {"latex", "markdown"}),
    ("Dear all, the meeting is at 10:30 in room B-12. Costs were $300 for food and $45 for drinks. See you!", set()),
    ("The function returns a[i] * b[j] + c; if a < b && c > d it fails. Files are under C:\\Temp\\logs\\new.", set()),
    ("Q: what about vector<int> and std::map<Key, Value>? A: both fine; use snake_case_names and __init__ as is.", set()),
    ("He said [sic] that 5 * 6 * 7 = 210, i.e. ~200 (about 95%). Issue #7 & others remain; C# is next.", set()),
    ("user: maria\nrole: admin\nquota = 50\npath: /home/maria/*.txt", set()),
    ("Rock 'n' roll isn't dead; it's 'resting'. 1 < 2, 3 > 2, A | B, x ^ y, {a, b}, f(x) -> y.", set()),
    ("Prices: $5, $6 and $7. Email me @ home; 50% off - today only! ~ The Team", set()),
    ("see src/core_utils/read_file.py and tests/test_read_file.py; run ./x --flag=*.md", set()),
    ("AT&T and R&B; fish&chips; a&b.", set()),
    ("Temperature fell to -5 degrees - a record - and rose to +3.", set()),
    ("x <- c(1,2,3); y = x[1]; s = \"${HOME}/bin\"; t = '$5'", set()),
]


# written after the composer and the features were done, and never used to change them
FRESH = [
    ("## Usage\n\n`grep -r foo .` finds it. *Note*: slow.\n\n+ fast\n+ small", {"markdown"}),
    ("1) open\n2) close\n\n> quoted **text**", {"markdown"}),
    ("~~~\nraw <i>x</i>\n~~~\n\nAfter the fence.", {"markdown"}),
    ("Link to [home](https://example.net) and an ![icon](i.png).", {"markdown"}),
    ("=== Early life ===\nBorn in [[1901]], she moved to '''Tarn'''.", {"wiki"}),
    ("{{stub}}\n* [[One]]\n* [[Two|2]]", {"wiki"}),
    ("{| border=1\n|+ Caption\n|-\n| x || y\n|}", {"wiki"}),
    ("See [https://example.com the site] and ''italics''.", {"wiki"}),
    ("\\subsection*{Setup}\nLet $n \\in \\mathbb{N}$ and \\texttt{code}.", {"latex"}),
    ("\\begin{align*}\na &= b \\\\\nc &= d\n\\end{align*}", {"latex"}),
    ("Cost is O($n^2$) by \\cite{knuth}.", {"latex"}),
    ("<article><h2>News</h2><p>All <strong>good</strong>.</p></article>", {"html"}),
    ("Price&nbsp;list: <span style='color:red'>5</span>", {"html"}),
    ("<ol><li>one</li><li>two</li></ol>", {"html"}),
    ("The ratio was 3:2, i.e. 60% (p < 0.05, n = 12); see Fig. 3 [right].", set()),
    ("Send it to a_b@example.org, cc: team; path ./a/b_c/*.py; 2*3*4=24.", set()),
    ("It's 5 o'clock; the dogs' bowls cost $3 and the cats' $4 each.", set()),
    ("status: done\nowner: lena\ndue: 2024-05-01", set()),
    ("if (a && !b || c <= d) then e++; else f--; // D:\\x\\y", set()),
]


@pytest.mark.parametrize("pages", [PAGES, FRESH], ids=["seen", "fresh"])
def test_kinds_of_pages_written_by_hand(reader, pages):
    """Pages of which all kinds come out and no other; the README states the shares."""
    wrong = [(text, kinds, got) for text, kinds in pages if (got := reader.read(text).kinds()) != kinds]
    assert len(wrong) <= 0.05 * len(pages), wrong


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("{{note|" + "long text " * 140 + "}} follows.", "wiki"),
        ("Some **" + "bold words " * 41 + "end** here.", "markdown"),
        ("{{Infobox river\n" + "".join(f"| field_{i} = value {i} of the river\n" for i in range(60)) + "}}\nIt is a river.", "wiki"),
        ("[[File:map.png|thumb|A map of [[Orvale]] and " + "more " * 200 + "]]", "wiki"),
        ("\\footnote{" + "A long note.\n" * 100 + "}", "latex"),
    ],
)
def test_long_constructs_have_their_kind_only(reader, text, kind):
    assert reader.read(text).kinds() == {kind}


def test_what_stands_inside_counts_too(reader):
    assert reader.read("{{quote\n| text = See <b>this</b> now\n| by = [[Orvale]]\n}}").kinds() == {"wiki", "html"}
    got, _ = markup.clean(reader.read("{{quote|text=See '''this''' in [[Orvale|the village]]|{{small|now}}}}"))
    assert got == "See this in the village now"
    got, _ = markup.clean(reader.read("\\textbf{very \\emph{old \\underline{stone}} bridge}"))
    assert got == "very old stone bridge"


@pytest.mark.parametrize(
    ("text", "has", "hasnt", "counts"),
    [
        ("<h2>Tools</h2><ul><li>saw</li><li>file</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x &lt; y\n  z</pre><p>5 &lt; 6</p>", ["§§ Tools", "• saw", "• file", "a\tb", "    x", "5 < 6"], ["<li>", "<td>", "</h2>"], {"headings": 1, "items": 2, "tables": 1, "code_blocks": 1}),
        ("# Tools\n\n1. saw\n2. file\n\n```sh\nls **\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n$x^2$ and **bold `code`**", ["§ Tools", "1. saw", "    ls **", "⟦x^2⟧", "bold code"], ["```", "|---|", "**bold"], {"headings": 1, "items": 2, "tables": 1, "code_blocks": 1, "formulas": 1}),
        ("== Tools ==\n\n* saw\n* [[File (tool)|file]]\n\n{|\n| a || b\n|-\n| c || d\n|}\n\n<math>x^2</math> and '''bold'''", ["§§ Tools", "• saw", "• file", "a \t b", "bold"], ["==", "[[", "{|", "'''"], {"headings": 1, "items": 2, "tables": 1}),
        ("\\section{Tools}\n\\begin{itemize}\n\\item saw\n\\item \\textbf{file}\n\\end{itemize}\n\\begin{equation}\nx^2\n\\end{equation}\n\\begin{verbatim}\nls **\n\\end{verbatim}", ["§ Tools", "• saw", "• file", "⟦x^2⟧", "    ls **"], ["\\item", "\\begin", "\\textbf"], {"headings": 1, "items": 2, "formulas": 1, "code_blocks": 1}),
    ],
    ids=["html", "markdown", "wiki", "latex"],
)
def test_clean_text_keeps_structure_of_each_kind(reader, text, has, hasnt, counts):
    got, n = markup.clean(reader.read(text))
    assert all(x in got for x in has), got
    assert not any(x in got for x in hasnt), got
    assert {k: n[k] for k in counts} == counts


@pytest.mark.parametrize("unit", ["<code>", "<p>", "<x1>", "</p>", "{{", "[[a|", "\\a[", "\\a{", "[//a ", "''a ", "<b>c", "{{a|b}}", "\\[", "$$", "<!--", "`a", "| a ", "\n* a", "&amp;"])
def test_time_grows_with_length(unit):
    """A page of a megabyte takes about four times as long as one of a quarter."""

    def took(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        markup.leaves(text)
        return time.process_time() - began

    small, large = took(250_000), took(1_000_000)
    assert large < 8 * small + 0.5


def test_distinct_unclosed_tags_take_linear_time():
    text = "".join(f"<t{i}>" for i in range(100_000))
    began = time.process_time()
    markup.leaves(text)
    assert time.process_time() - began < 10


def test_memo_is_bounded(monkeypatch, reader):
    monkeypatch.setattr(markup, "MEMO", 1000)
    own = markup.Reader(reader.crf)
    for i in range(300):
        own.read("**a** " * (i % 50) + "\n# b")
    assert sum(map(len, own.known)) <= 1000 + 200
