"""Main text of web pages by a graphical model on the DOM tree.

Each node (block element or run of text) is content or not. A node's own features give it a potential, each parent and
child pair has one, both learned by counting on labelled pages; one pass of messages up and one down the tree give every
node's exact marginal. Text whose marginal is over a half is content.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import table, text_slices, texts_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements whose content is no text of the page. Unlike scripts, styles and text areas they end with the page only if they are closed.
DROPPED = frozenset("noscript template svg iframe object select button canvas audio video".split())
NESTED = frozenset("svg object template noscript".split())
EDGE = re.compile(rf"<(/?)({'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
#: Class words that begin with "ad" and are no adverts.
LATIN = re.compile(r"(?<![A-Za-z])ad[-_]?(?:hoc|hominem|infinitum|interim|lib|libitum|nauseam)(?![A-Za-z])", re.I)
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html head title".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: What only a whole page holds: a form around one of these is the page's frame.
OUTER = frozenset("article main nav header footer aside h1".split())
GROUPS = {"html": "root", "body": "root", "div": "box", "section": "box", "center": "box", "td": "box", "tr": "box", "tbody": "box", "table": "box", "main": "main", "article": "main"} | dict.fromkeys(("nav", "header", "footer", "aside", "form", "menu"), "frame")


class Node:
    __slots__ = ("tag", "marks", "parent", "children", "text", "linked", "chars", "label")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: int):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.text: list[str] | None = None
        self.linked, self.chars, self.label = 0, 0, None


def dropped_parts(page: str) -> dict[int, int]:
    """Where each dropped element starts and where it ends. One that is not closed, or that a second one of its kind cuts short, is a mere tag; so is <svg/>."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in EDGE.finditer(page):
        name, end = m[2].lower(), page.find(">", m.end()) + 1
        if not end:
            break
        mine = open_.setdefault(name, [])
        if m[1]:
            if mine:
                out[mine.pop()] = end
        elif page[end - 2] != "/":
            if name not in NESTED:
                mine.clear()
            mine.append(m.start())
    return out


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root. Scripts, styles, controls and comments are left out.

    Inline elements make no nodes: their text belongs to the run they stand in, links are counted. A run ends where a
    block begins or ends. Tags that nothing closes or opens do no harm: an end tag without a start is skipped. Forms that
    frame the page and headers of articles become plain boxes (`plain_boxes`). Time is linear in the page, however deep it is.
    """
    nodes = [Node("root", (), -1)]
    open_, at, linked, run = [0], 0, 0, -1
    places: dict[str, list[int]] = {}  # of the open elements of each tag in open_

    def add(text: str) -> None:
        nonlocal run
        if not text:
            return
        if run < 0:
            if text.isspace():
                return
            run = len(nodes)
            nodes.append(Node("#", (), open_[-1]))
            nodes[open_[-1]].children.append(run)
            nodes[run].text = []
        nodes[run].text.append(text)
        if linked:
            nodes[run].linked += len(text)

    def close(to: int) -> None:
        nonlocal run, linked
        for i in open_[to:]:
            places[nodes[i].tag].pop()
        del open_[to:]
        run, linked = -1, 0

    dropped = dropped_parts(page)
    for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):  # without a ">" to come nothing is a tag
        if m.start() < at:  # inside a dropped element
            continue
        add(page[at : m.start()])
        at = max(m.end(), dropped.get(m.start(), 0))
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
        elif tag == "a":
            linked = 0 if m[2] else 1
        elif tag not in BLOCK:
            continue
        elif m[2]:
            if places.get(tag):
                close(places[tag][-1])
        else:
            run, linked = -1, 0
            if tag in CLOSES_P and nodes[open_[-1]].tag == "p":
                close(len(open_) - 1)
            if tag in SAME:
                last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
                if last(SAME[tag]) > last(STOPS.get(tag, ())):
                    close(last(SAME[tag]))
            marks = tuple(sorted({w.lower() for x in MARKS.findall(m[4]) for y in x if y for w in PARTS.findall(LATIN.sub(" ", y))})) if m[4] else ()
            nodes.append(Node(tag, marks, open_[-1]))
            nodes[open_[-1]].children.append(len(nodes) - 1)
            places.setdefault(tag, []).append(len(open_))
            open_.append(len(nodes) - 1)
    add(page[at:])
    for n in nodes:
        if n.text is not None:
            joined = "".join(n.text)
            n.text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            n.chars = len(n.text)
    plain_boxes(nodes)
    return nodes


def plain_boxes(nodes: list[Node]) -> None:
    """Makes boxes of what frames an article instead of standing beside it.

    A form is such a frame if it holds an article, a main part, a heading of the first rank or other parts of a page, or if
    it stands right in the body and holds over half of the page's text; its controls are left out in any case. A header is one
    if the nearest element of GROUPS' kinds main or frame around it is an article.
    """
    if not any(n.tag in ("form", "header") for n in nodes):
        return
    chars, outer = [n.chars for n in nodes], [n.tag in OUTER for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        outer[nodes[i].parent] |= outer[i]
    around = [""] * len(nodes)  # the nearest such element, itself included
    for i, n in enumerate(nodes):
        above = around[n.parent] if i else ""
        if n.tag == "form" and (outer[i] or (nodes[n.parent].tag in ("root", "html", "body") and 2 * chars[i] > chars[0])) or n.tag == "header" and above == "article":
            n.tag, around[i] = "div", above
        else:
            around[i] = n.tag if GROUPS.get(n.tag) in ("main", "frame") else above


def features(nodes: list[Node], i: int) -> tuple[tuple, ...]:
    """What a node shows of itself: tag and class words of elements (comments are articles too, but have class words); size, share of links and closing sign of text."""
    n = nodes[i]
    if n.text is None:
        return (("tag", n.tag, n.tag == "article" and not n.marks), *(("mark", m) for m in n.marks))
    size = min(6, int(math.log2(n.chars + 1) / 1.5))
    links = 0 if not n.linked else 1 if 3 * n.linked < n.chars else 2
    return (("text", nodes[n.parent].tag, size), ("links", links, size > 2), ("end", n.text[-1:] in ".!?…:\"'»”。", size))


def group(n: Node) -> str:
    return "text" if n.text is not None else GROUPS.get(n.tag, "other")


class Model:
    """Log-odds of features, and P(child | parent, the parent's group), from counts on labelled trees."""

    def __init__(self, pages: list[list[Node]], smooth: float = 0.5):
        seen, edges, totals = {0: Counter(), 1: Counter()}, Counter(), Counter()
        for nodes in pages:
            for i, n in enumerate(nodes):
                totals[n.label] += 1
                seen[n.label].update(features(nodes, i))
                if n.parent >= 0:
                    edges[group(nodes[n.parent]), nodes[n.parent].label, n.label] += 1
        sides = {kind: tuple(sum(c for f, c in seen[y].items() if f[0] == kind) for y in (0, 1)) for kind in {f[0] for y in (0, 1) for f in seen[y]}}
        kinds = Counter(f[0] for f in set(seen[0]) | set(seen[1]))
        self.weight = {}
        for f in set(seen[0]) | set(seen[1]):
            n0, n1 = sides[f[0]]
            p0, p1 = ((seen[y][f] + smooth) / (n + smooth * kinds[f[0]]) for y, n in ((0, n0), (1, n1)))
            self.weight[f] = math.log(p1 / p0)
        self.edge = {}
        for g in ("root", "box", "main", "frame", "other", "text"):
            for y in (0, 1):
                a, b = edges[g, y, 0] + smooth, edges[g, y, 1] + smooth
                self.edge[g, y] = (a / (a + b), b / (a + b))
        self.prior = (totals[0] + 1, totals[1] + 1)
        self.frames = frozenset(t for t, g in GROUPS.items() if g == "frame")
        self.known: dict[tuple, tuple[float, float]] = {}

    def own(self, nodes: list[Node], i: int) -> tuple[float, float]:
        """A node's potential."""
        fs = features(nodes, i)
        got = self.known.get(fs)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            certain = -9.0 if fs[0][0] == "tag" and fs[0][1] in self.frames else 0.0  # what these elements hold is never the article's
            p = 1 / (1 + math.exp(-max(-9.0, min(9.0, certain + sum(self.weight.get(f, 0.0) for f in fs)))))
            got = self.known[fs] = (1 - p, p)
        return got

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages from the leaves to the root, then from the root to the leaves."""
        n = len(nodes)
        own = [self.own(nodes, i) for i in range(n)]
        up, message = list(own), [(1.0, 1.0)] * n
        tables = [None] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            p = nodes[i].parent
            g = group(nodes[p])
            (e00, e01), (e10, e11) = tables[i] = (self.edge[g, 0], self.edge[g, 1])
            u0, u1 = up[i]
            m0, m1 = e00 * u0 + e01 * u1, e10 * u0 + e11 * u1
            s = m0 + m1
            message[i] = (m0 / s, m1 / s)
            v0, v1 = up[p][0] * m0 / s, up[p][1] * m1 / s
            t = v0 + v1
            up[p] = (v0 / t, v1 / t) if t > 0 else (0.5, 0.5)
        belief = [(0.5, 0.5)] * n
        b0, b1 = up[0][0] * self.prior[0], up[0][1] * self.prior[1]
        belief[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        for i in range(1, n):
            p = nodes[i].parent
            (e00, e01), (e10, e11) = tables[i]
            q0, q1 = belief[p][0] / max(message[i][0], 1e-300), belief[p][1] / max(message[i][1], 1e-300)
            d0, d1 = (q0 * e00 + q1 * e10) * up[i][0], (q0 * e01 + q1 * e11) * up[i][1]
            s = d0 + d1
            belief[i] = (d0 / s, d1 / s) if s > 0 else (0.5, 0.5)
        return [b[1] for b in belief]


#: Labelled pages to learn from: y="1" marks content, y="0" the rest; nodes take the mark of the nearest marked ancestor.
#: {s} short, {m} middle and {l} long sentences of made-up words, {k} a few words.
FRAMES = [
    ("article", "<article y='1'><h1>{s}</h1>{body}</article>"),
    ("main", "<main y='1'><h1>{s}</h1>{body}</main>"),
    ("post", "<div class='post-content' y='1'><h2>{s}</h2>{body}</div>"),
    ("content", "<div id='content'><div class='article-body' y='1'>{body}</div></div>"),
    ("entry", "<section class='entry text' y='1'><h1>{s}</h1>{body}</section>"),
    ("story", "<div id='main'><div class='story' y='1'>{body}</div></div>"),
    ("cell", "<table><tr><td class='left'><ul y='0'><li><a>{k}</a></li><li><a>{k}</a></li></ul></td><td y='1'>{body}</td></tr></table>"),
    ("wrapped", "<div class='wrapper'><div class='container'><article class='post' y='1'><h1>{s}</h1>{body}</article></div></div>"),
]
BODIES = [
    "<p>{l}</p><p>{m}</p><p>{l}</p><p>{s}</p>",
    "<p>{m}</p><h2>{k}</h2><p>{l}</p><ul><li>{s}</li><li>{m}</li></ul><p>{l}</p>",
    "<p>{l}</p><div class='ad' y='0'>{s}</div><p>{m}</p><blockquote><p>{m}</p></blockquote><p>{k}.</p>",
    "<p>{l} <a>{k}</a> {l}</p><figure><figcaption>{s}</figcaption></figure><p>{m}</p><aside class='related' y='0'><ul><li><a>{k}</a></li><li><a>{k}</a></li></ul></aside><p>{l}</p>",
    "<div>{l}</div><div>{m}</div><table><tr><td>{k}</td><td>{k}</td></tr></table><p>{l}</p>",
    "<p>{s}</p><p>{s}</p><p>{m}</p><pre>{m}</pre><div class='share social' y='0'><a>{k}</a><a>{k}</a></div>",
    "<p>{s}</p>",
    "<p>{k} | {k} |</p><p>{l}</p><p>{k}</p><p>{s} *</p><p>{k} $</p>",
    "<p>{k}</p><p>{k} {k} -</p><ul><li>{k}</li><li>{k}</li></ul><p>{m}</p><h3>{k}</h3><p>{k}</p>",
]
BEFORE = [
    "<nav><ul><li><a>{k}</a></li><li><a>{k}</a></li><li><a>{k}</a></li><li><a>{k}</a></li></ul></nav>",
    "<header class='site-header'><div class='logo'>{k}</div><p>{s}</p></header><nav class='menu'><a>{k}</a><a>{k}</a></nav>",
    "<div id='header'><h1>{k}</h1></div><div class='navigation menu'><ul><li><a>{k}</a></li><li><a>{k}</a></li></ul></div>",
    "<div class='cookie notice banner'><p>{m}</p><p>{s}</p></div><nav><ul><li><a>{k}</a></li><li><a>{k}</a></li></ul></nav>",
    "<div class='breadcrumb'><a>{k}</a> <a>{k}</a></div><form class='search'><p>{s}</p></form>",
    "<div class='ad advert'>{m}</div>",
    "<div class='ads sponsored promo'><p>{m}</p><p>{s}</p></div><header><p>{s}</p></header>",
]
AFTER = [
    "<footer>{s}</footer>",
    "<aside class='sidebar'><h3>{k}</h3><p>{m}</p><ul><li><a>{k}</a></li><li><a>{k}</a></li></ul></aside><footer><p>{s}</p></footer>",
    "<div class='comments' id='comments'><h3>{k}</h3><div class='comment'><p>{m}</p></div><div class='comment'><p>{l}</p></div></div><div id='footer'><p>{s}</p></div>",
    "<section class='comments'><article class='comment'><p>{m}</p></article><article class='comment reply'><p>{m}</p></article></section><footer>{s} <a>{k}</a></footer>",
    "<div class='related recommended'><h3>{k}</h3><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></div><form class='newsletter subscribe'><p>{s}</p></form><footer class='footer'><p>{m}</p></footer>",
    "<div class='sidebar widget'><p>{m}</p></div><div class='copyright legal'>{s}</div>",
    "<div class='popup modal notice'><p>{m}</p></div><ol class='comment-list'><li class='comment'><p>{m}</p></li></ol><footer><ul><li><a>{k}</a></li></ul></footer>",
    "",
]


def training_pages() -> list[tuple[str, int]]:
    """A page for each frame, body and a pair of surroundings, with made-up sentences of many lengths."""
    out, state = [], 1

    def words(n: int) -> str:
        nonlocal state
        got = []
        for _ in range(n):
            state = (state * 1_103_515_245 + 12_345) % (1 << 31)
            got.append("".join("bcdfglmnprst"[(state >> s) % 12] + "aeiou"[(state >> (s + 4)) % 5] for s in (6, 12, 18))[: 2 + (state >> 8) % 5])
        return " ".join(got)

    def fill(m: re.Match) -> str:
        nonlocal state
        state = (state * 1_103_515_245 + 12_345) % (1 << 31)
        r = (state >> 10) % 100
        n = {"k": 1 + r % 3, "s": 3 + r % 9, "m": 12 + r % 25, "l": 40 + 2 * r}[m[1]]
        return words(n) + ("" if m[1] == "k" else ".")

    for i, (_, frame) in enumerate(FRAMES):
        for j, body in enumerate(BODIES):
            for k in range(3):
                before, after = BEFORE[(i + 2 * j + 3 * k) % len(BEFORE)], AFTER[(2 * i + j + 5 * k) % len(AFTER)]
                page = f"<html><head><title>{{s}}</title></head><body y='0'>{before}{frame.replace('{body}', body)}{after}</body></html>"
                out.append(re.sub(r"\{([ksml])\}", fill, page))
    return out


def labelled(page: str) -> list[Node]:
    """The page's tree; a node's label is its own mark or that of the nearest marked ancestor, a box's is its text's majority."""
    marked = re.sub(r"<(\w+)([^>]*) y='([01])'>", lambda m: f"<{m[1]}{m[2]} role='ylabel{'no' if m[3] == '0' else 'yes'}'>", page)
    nodes = parse(marked)
    for n in nodes:
        own = [m for m in n.marks if m.startswith("ylabel")]
        n.label = int(own[0] == "ylabelyes") if own else nodes[n.parent].label if n.parent >= 0 else 0
        n.marks = tuple(m for m in n.marks if not m.startswith("ylabel"))
    inside = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.text is not None:
            inside[i][n.label] += n.chars
        elif n.label == 0 and inside[i][1] > inside[i][0]:
            n.label = 1
        if n.parent >= 0:
            inside[n.parent][0] += inside[i][0]
            inside[n.parent][1] += inside[i][1]
    return nodes


@lru_cache(1)
def model() -> Model:
    return Model([labelled(p) for p in training_pages()])


def blocks(page: str, own: Model, least: float = 0.5) -> list[str]:
    """The content blocks of a page, in page order."""
    nodes = parse(page)
    return [n.text for n, p in zip(nodes, own.marginals(nodes)) if n.text and p > least]


def extract_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), fit: Model | None = None) -> DataFrame:
    """The columns of `keep`, text (blocks joined by a line feed; empty if none) and n_chars (its code points).

    Null or empty pages have an empty text. Pages of any length are read whole. Repeated rows stay, an empty table gives
    an empty result, other columns are dropped, and so are columns of `keep` named text or n_chars. `fit`: a model trained elsewhere.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    frame = pages.select(F.struct(*keep).alias("row"), F.col(page).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fit or model()
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = ["\n".join(blocks(x, own)) if x else "" for x in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], ["row", "text", "n_chars"])

    out = frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select("row.*", "text", "n_chars")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
