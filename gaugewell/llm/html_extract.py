"""Main text of web pages by a tree-structured graphical model over their block elements.

Each block element of a page is a node that is content or not. Its own potential is a logistic function of its tag, the words of its
class, id and role, and the shape of the text below it; the potential between parent and child says how often a child is content
depending on what its parent is. Both are fitted together to labelled pages. Sum-product messages up and down the tree give the exact probability of
each node, and the text blocks of nodes that are likelier content than not are the main text. A page without block elements has no tree
to judge: all its text is main text. Forms and their controls are never part of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.shared import bounded_batches

# fixed values: elements of HTML by kind
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg canvas audio video select textarea button datalist annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl menu div article section main aside nav header footer form td th blockquote details".split())
TAG_KINDS = ("article main", "section", "html body", "div center", "p pre blockquote figcaption", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl dir",
             "li dt dd", "table tbody thead tfoot tr td th", "nav menu", "header", "footer address", "aside", "form fieldset dialog search", "figure details summary")
GOOD_WORDS = frozenset("article articlebody content entry main post story text body prose".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus foot footer "
    "header login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply response "
    "search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar widget complementary".split())
_KIND = {tag: i for i, tags in enumerate(TAG_KINDS) for tag in tags.split()}


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    main: str = ""
    chars: int = 0
    linked: int = 0
    blocks: int = 0
    stops: int = 0


@dataclass
class Page(HTMLParser):
    """Block elements of a page, and its text blocks as (node, text). Elements may be left open; unknown end tags are ignored."""

    nodes: list[Node] = field(default_factory=lambda: [Node("html", -1)])
    texts: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.hidden, self.links, self.parts = 0, 0, []

    def read(self, html: str) -> Page:
        self.feed(html)
        self.close()
        self.end_block()
        for i in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            node, above = self.nodes[i], self.nodes[self.nodes[i].parent]
            above.chars, above.linked, above.blocks, above.stops = above.chars + node.chars, above.linked + node.linked, above.blocks + node.blocks, above.stops + node.stops
        return self

    def end_block(self) -> None:
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            at = self.open[-1][1]
            node = self.nodes[at]
            node.chars += len(text)
            node.linked += min(len(text), sum(len(p) for p, linked in self.parts if linked))
            node.blocks += 1
            node.stops += len(re.findall(r"[.!?](?:\s|$)", text))
            self.texts.append((at, text))
        self.parts = []

    def pop(self) -> None:
        tag, _ = self.open[-1]
        if tag in BLOCK:
            self.end_block()
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"
        self.open.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append((" ", False))
            return
        if tag == "html":
            return
        if tag == "body":
            while any(t == "head" for t, _ in self.open):
                self.pop()
        if tag in BLOCK:
            self.end_block()
            closed = CLOSED_BY.get(tag, set()) | {"p"}
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in closed:
                    while len(self.open) > i:
                        self.pop()
                elif self.open[i][0] in SCOPE and self.open[i][0] not in closed:
                    break
        if tag in VOID:
            return
        at = self.open[-1][1]
        if tag in BLOCK:
            values = dict(attrs)
            named = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role"))))
            self.nodes.append(Node(tag, at, tuple(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())), (values["data-main"] or "yes") if "data-main" in values else ""))
            at = len(self.nodes) - 1
        self.open.append((tag, at))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe") and self.open[-1][0] == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or all(t != tag for t, _ in self.open[1:]):
            return
        while self.open[-1][0] != tag:
            self.pop()
        self.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append((data, self.links > 0))


def inputs(nodes: list[Node]) -> np.ndarray:
    """Features of each node."""
    out = np.zeros((len(nodes), len(TAG_KINDS) + 8))
    for row, n in zip(out, nodes):
        if n.tag in _KIND:
            row[_KIND[n.tag]] = 1
        row[-8:] = (min(2, sum(w in GOOD_WORDS for w in (*n.words, n.tag))), min(2, sum(w in BAD_WORDS for w in (*n.words, n.tag))), math.log1p(min(n.chars, 2000)) / 5,
                    n.linked / max(n.chars, 1), min(2.0, 50 * n.stops / max(n.chars, 1)), math.log1p(n.chars / max(n.blocks, 1)) / 5, n.chars == 0, 1)
    return out


@dataclass(frozen=True)
class TreeModel:
    """Weights of the nodes' own log odds, and log potentials [parent is content][child is content]."""

    weights: tuple[float, ...]
    joint: tuple[tuple[float, float], tuple[float, float]]


def sum_product(own: np.ndarray, parent: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) of each node, P(parent, child) of each node with a parent) in a forest whose parents come before their children.

    own holds log odds, parent the number of the parent or -1. Messages of all nodes of a depth are passed at once.
    """
    depth = np.zeros(len(own), np.int64)
    for i in range(len(own)):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1)]
    up = np.column_stack([np.zeros(len(own)), own])
    message, down = np.zeros_like(up), np.zeros_like(up)
    for at in reversed(levels):
        message[at] = np.logaddexp(joint[:, 0] + up[at, :1], joint[:, 1] + up[at, 1:])
        message[at] -= message[at].max(1, keepdims=True)
        np.add.at(up, parent[at], message[at])
    for at in levels:
        rest = up[parent[at]] + down[parent[at]] - message[at]
        down[at] = np.logaddexp(joint[0] + rest[:, :1], joint[1] + rest[:, 1:])
        down[at] -= down[at].max(1, keepdims=True)
    total = up + down
    at = np.flatnonzero(parent >= 0)
    pair = (up[parent[at]] + down[parent[at]] - message[at])[:, :, None] + joint + up[at][:, None, :]
    pair = np.exp(pair - pair.max((1, 2), keepdims=True))
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), pair / pair.sum((1, 2), keepdims=True)


def train(pages: list[str], steps: int = 400, shrink: float = 0.001) -> TreeModel:
    """Maximises the likelihood of the labels of pages by gradient steps; data-main marks content, data-main=no an exception in it."""
    x, label, parent = [], [], []
    for html in pages:
        page, first = Page().read(html), len(label)
        for n in page.nodes:
            parent.append(n.parent + first if n.parent >= 0 else -1)
            label.append(int(n.main == "yes" or (n.main == "" and n.parent >= 0 and label[n.parent + first] == 1)))
        x.append(inputs(page.nodes))
    x, y, parent = np.concatenate(x), np.array(label), np.array(parent)
    at = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[at]], y[at]), 1)
    theta = np.zeros(x.shape[1] + 4)
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):  # Adam
        p, pair = sum_product(x @ theta[:-4], parent, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - p), (seen - pair.sum(0)).ravel()]) / len(pages) - shrink * theta
        first_moment, second_moment = 0.9 * first_moment + 0.1 * slope, 0.99 * second_moment + 0.01 * slope**2
        theta += 0.1 * first_moment / (1 - 0.9**step) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    return TreeModel(tuple(theta[:-4].tolist()), tuple(map(tuple, theta[-4:].reshape(2, 2).tolist())))


def extract(htmls: list[str | None], model: TreeModel) -> list[str]:
    """Main texts of pages."""
    pages = [Page().read(h or "") for h in htmls]
    if not pages:
        return []
    first = np.cumsum([0] + [len(p.nodes) for p in pages])
    parent = np.array([n.parent + f if n.parent >= 0 else -1 for p, f in zip(pages, first) for n in p.nodes])
    p, _ = sum_product(inputs([n for page in pages for n in page.nodes]) @ np.array(model.weights), parent, np.array(model.joint))
    out = []
    for page, f in zip(pages, first):
        forms = in_forms(page.nodes)
        out.append("\n".join(text for at, text in page.texts if len(page.nodes) == 1 or (p[f + at] > 0.5 and not forms[at])))
    return out


def in_forms(nodes: list[Node]) -> list[bool]:
    """Whether a node belongs to a form. A form around an article, a main element or a first heading is the page's frame, not a form."""
    frame = [n.tag in ("article", "main", "h1") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        frame[nodes[i].parent] |= frame[i]
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = n.tag == "form" and not frame[i] or n.parent >= 0 and inside[n.parent]
    return inside


def _extract(batches: Iterator[pa.RecordBatch], model: TreeModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t for i in range(0, len(batch), 64) for t in extract(batch.column(2).slice(i, 64).to_pylist(), model)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


# fixed values: parts of the labelled pages, by what they are
_SAY = ("The river rose again in the night, and by morning the lower road was closed.", "Nobody had counted on that; the gauges showed less.",
        "In spring the fields take most of the water, so the town is used to it.", "Repairs will need a week. The council has agreed to pay for them.")
_CONTENT = (
    "<article{m}><h1>A river in the town</h1><p>{0} {1}</p><p>{2}</p>{inner}<p>{3}</p></article>",
    "<article{m}><h1>{0}</h1><p><b>{0}<br><p>{1} {2}</p><p>Yes.</p><p>{3} {2} {1}</p>{inner}</article>",
    "<article{m}><h1>Rain</h1><p>Rain.</p>{inner}</article>",
    "<article{m}>{inner}<h1>{1}</h1><p>{1}</p></article>",
    '<div class="post-content"{m}><h2>Water</h2><p>{0} <a href="/x">{1}</a> {2}</p>{inner}<ul><li>{2}</li><li>One</li></ul></div>',
    "<main{m}><h1>Short news</h1><p>{1}</p>{inner}<blockquote>{2}</blockquote><p>{3}</p></main>",
    '<div id="content"{m}><p>{3} {0}</p>{inner}<table><tr><td>Level</td><td>4 metres.</td></tr></table><p>{2}</p></div>',
    '<section class="entry"{m}><h1>Floods</h1><div>{0} {2}</div>{inner}<p>Ok</p><pre>{1}</pre></section>',
    "<div{m}><h2>{0}</h2><p>{1} {2} {3}</p>{inner}<p>{0} {3}</p></div>",
    "<h1{m}>The water</h1><p{m}>{0} {1}</p>{inner}<p{m}>{2} {3}</p>",
)
_OTHER = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">the</a></li><li><a href="/c">About us,</a></li></ul></nav>',
    '<header><h1><a href="/">The Daily</a></h1><p>News from the valley.</p></header>', '<div class="ad">Buy two pumps and get one free. Order now.</div>',
    '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/p">Ten boats</a></li><li><a href="/q">A bridge</a></li></ul><p>Most read this week.</p></div>',
    '<aside><h2>Weather</h2><p>Rain, then sun. Ten degrees.</p></aside>', '<div class="cookie-notice"><p>We use cookies to make this page better.</p><button>Accept</button></div>',
    '<form action="/s"><label>Search</label><input name="q"><p>Type a word and press enter.</p></form>', "<footer>&copy; 2020 The Daily &middot; All rights reserved.</footer>",
    '<footer><p>Contact us by mail. <a href="/imprint">Imprint</a></p></footer>', '<div class="menu"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div>',
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I saw it with my own eyes. It was worse than they say.</p></div><div class="comment"><p>Agreed!</p></div></section>',
    '<div class="related"><h3>Read more</h3><a href="/r">The old mill</a></div>', '<ol class="comments"><li>Thank you for this. I live there.</li><li>When will it open again?</li></ol>',
)

@lru_cache(1)
def default_model() -> TreeModel:
    """The model of the labelled pages made of the parts above: each content, alone and with each other part inside it, among others."""
    pages = []
    inner = ["", *(re.sub(r"^<(\w+)", r'<\1 data-main="no"', part) for part in _OTHER)]
    for i, content in enumerate(_CONTENT):
        for j, part in enumerate(inner):
            around = [_OTHER[(i + 3 * j + 5 * s) % len(_OTHER)] for s in range(4)]
            body = content.replace("{m}", " data-main").replace("{inner}", part)
            for s, say in enumerate(_SAY):
                body = body.replace("{%d}" % s, " ".join([say] * (1 + (i + j + s) % 3)))
            pages.append(f"<html><head><title>t</title></head><body>{around[0]}{around[1]}{body}{around[2]}{around[3]}</body></html>")
    return train(pages)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per input row: id, url, text (empty if there is none), n_chars (its code points).

    Null and empty html give an empty text. Rows with null or repeated ids are read like any other; other columns are ignored. An
    empty table gives an empty result.
    """
    source = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = f"id {source.schema['id'].dataType.simpleString()}, url string, text string"
    found = source.mapInArrow(partial(_extract, model=model or default_model()), kinds)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
