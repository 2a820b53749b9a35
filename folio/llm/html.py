"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements. Every node gets features: density of its subtree, tokens of
its attributes and of its ancestors', depth, its standing among siblings. Boosted trees give each node
the probability of three states: outside (a frame around both kinds), main, or clutter. Decoding picks
the likeliest states for the whole tree at once under rules that keep ancestors and descendants in
accord: below clutter all is clutter, below main nothing is outside again.

The trees are fitted on pages that this module composes itself, whose main text is known.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _store, _text

OUTSIDE, MAIN, CLUTTER = range(3)
PAGES, ROUNDS, DEPTH, RATE, BINS = 500, 24, 3, 0.3, 32

#: Element kinds of the public HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption select option button label legend".split()
)
HIDDEN = frozenset("script style template noscript head title textarea svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = frozenset("ul ol dl table select menu body html article section div main".split())
GOOD_TOKENS = frozenset("article content main post entry story text body page single blog news copy prose hentry".split())
BAD_TOKENS = frozenset(
    "nav navbar navigation menu header masthead topbar footer foot bottom sidebar side aside widget rail ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert message comment comments disqus reply replies respond discussion form search login signin subscribe newsletter signup share sharing social related recommended more popular trending breadcrumb breadcrumbs pagination pager tags meta byline author toolbar popup modal overlay copyright legal disclaimer skip".split()
)
TAGS = ("body", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "p", "heading", "table", "other")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")


class Page:
    """The block tree of a page: parallel lists by node (parents stand before children), and its blocks of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.good, self.bad, self.gone = ["html"], [-1], [0], [0], [False]
        self.chars, self.linked, self.links, self.stops, self.words = [0], [0], [0], [0], [0]
        self.blocks: list[tuple[int, list[str]]] = []
        stack, link, fresh, at, n = [0], False, True, 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            text = html[at : m.start() if m else n]
            if text:
                plain = unescape(text)
                if fresh:
                    self.blocks.append((stack[-1], []))
                    fresh = False
                self.blocks[-1][1].append(plain)
                size = len(plain) - plain.count(" ")
                if not plain.isspace():
                    k = stack[-1]
                    self.chars[k] += size
                    self.words[k] += plain.count(" ") + 1
                    self.stops[k] += plain.count(".") + plain.count(",")
                    if link:
                        self.linked[k] += size
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link = False
                elif tag in BLOCKS or tag in HIDDEN:
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[depth]] == tag:
                            del stack[depth:]
                            fresh, link = True, False
                            break
                continue
            if tag == "br":
                if not fresh:
                    self.blocks[-1][1].append(" ")
                continue
            if tag == "a":
                link = True
                self.links[stack[-1]] += 1
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}", re.I).search(html, at)
                at = end.start() if end else n
                if not end:
                    break
                close = html.find(">", at)
                at = close + 1 if close >= 0 else n
                continue
            if tag not in BLOCKS and tag not in HIDDEN:
                continue
            fresh, link = True, False
            if tag == "hr":
                continue
            if tag == "body" and "head" in (self.tag[k] for k in stack):
                del stack[1:]
            if tag in ("html",):
                continue
            open_ = [self.tag[k] for k in stack]
            if tag in BLOCKS and "p" in open_ and tag not in ("option", "button", "label", "select"):
                del stack[len(open_) - 1 - open_[::-1].index("p") :]
            closes = CLOSES.get(tag)
            if closes:
                for depth in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[depth]]
                    if name in closes:
                        del stack[depth:]
                        break
                    if name in FENCES:
                        break
            self._add(tag, stack[-1], m[3] or "")
            if not m[3].endswith("/"):
                stack.append(len(self.tag) - 1)

    def _add(self, tag: str, parent: int, attrs: str) -> None:
        good = bad = 0
        gone = tag in HIDDEN or self.gone[parent]
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                for token in _PART.findall(value.lower()):
                    good += token in GOOD_TOKENS
                    bad += token in BAD_TOKENS
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
                gone = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.good.append(good)
        self.bad.append(bad)
        self.gone.append(gone)
        for column in (self.chars, self.linked, self.links, self.stops, self.words):
            column.append(0)

    def text(self, state: list[int] | np.ndarray) -> str:
        """The blocks of main nodes, white space as one space, joined by line breaks."""
        parts = (" ".join("".join(pieces).split()) for node, pieces in self.blocks if state[node] == MAIN and not self.gone[node])
        return "\n".join(p for p in parts if p)


_TAG_CODE = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": TAGS.index("heading") for k in range(1, 7)} | {"ol": TAGS.index("ul"), "menu": TAGS.index("ul"), "html": TAGS.index("body")}
_BY_TAG = {"nav": 1, "header": 1, "footer": 1, "aside": 1, "form": 1, "menu": 1, "dialog": 1, "select": 1, "button": 1}
COLUMNS = 24


def features(page: Page) -> np.ndarray:
    """A row of numbers for each node of the page."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.array([page.chars, page.linked, page.links, page.stops, page.words], float)
    gone = np.array(page.gone)
    own[:, gone] = 0
    below = own.copy()
    nodes = np.ones(n)
    for k in range(n - 1, 0, -1):
        below[:, parent[k]] += below[:, k]
        nodes[parent[k]] += nodes[k]
    code = np.array([_TAG_CODE.get(t, len(TAGS) - 1) for t in page.tag])
    paragraph = np.isin(code, (TAGS.index("p"), TAGS.index("heading"))).astype(float)
    prose = paragraph * (own[0] > 0)
    prose_below = prose.copy()
    good, bad = np.array(page.good, float), np.array(page.bad, float)
    semantic = np.array([_BY_TAG.get(t, 0) for t in page.tag], float)
    up_good, up_bad, up_semantic, up_article = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    depth, index, children = np.zeros(n), np.zeros(n), np.zeros(n)
    frame = np.isin(code, (TAGS.index("article"), TAGS.index("main"))).astype(float)
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        index[k] = children[p]
        children[p] += 1
        up_good[k], up_bad[k] = max(up_good[p], good[p]), max(up_bad[p], bad[p])
        up_semantic[k], up_article[k] = max(up_semantic[p], semantic[p]), max(up_article[p], frame[p])
    for k in range(n - 1, 0, -1):
        prose_below[parent[k]] += prose_below[k]
    frames_below = frame.copy()
    for k in range(n - 1, 0, -1):
        frames_below[parent[k]] += frames_below[k]
    total = max(1.0, below[0, 0])
    p = np.maximum(parent, 0)
    some = np.maximum(below[0], 1)
    x = np.empty((n, COLUMNS))
    x[:, 0] = code
    x[:, 1] = depth
    x[:, 2] = np.log1p(below[0])
    x[:, 3] = below[1] / some
    x[:, 4] = np.log1p(below[0] / nodes)
    x[:, 5] = below[0] / total
    x[:, 6] = below[3] / np.maximum(below[4], 1)
    x[:, 7] = np.log1p(below[2])
    x[:, 8] = np.minimum(good, 2)
    x[:, 9] = np.minimum(bad, 2)
    x[:, 10] = np.minimum(up_good, 2)
    x[:, 11] = np.minimum(up_bad, 2)
    x[:, 12] = semantic
    x[:, 13] = up_semantic
    x[:, 14] = frame
    x[:, 15] = up_article
    x[:, 16] = index
    x[:, 17] = children[p] - index
    x[:, 18] = below[0] / np.maximum(below[0][p], 1)
    x[:, 19] = np.log1p(prose_below)
    x[:, 20] = frames_below - frame
    x[:, 21] = np.log1p(own[0])
    x[:, 22] = below[0] / np.maximum(below[4], 1)
    x[:, 23] = np.log1p(prose_below[0] - prose_below)
    return x


class Trees:
    """Boosted regression trees of one depth for three classes, on binned features."""

    def __init__(self, edges: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.edges, self.feature, self.cut, self.value = edges, feature, cut, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T  # by feature
        bins = cls.binned(x, edges)
        n, d = bins.shape
        scores = np.zeros((n, 3))
        feature, cut, value = [], [], []
        flat = bins + np.arange(d) * BINS
        for _ in range(ROUNDS):
            e = np.exp(scores - scores.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            for c in range(3):
                g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
                node = np.zeros(n, np.int64)
                f_, c_ = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
                for level in range(DEPTH):
                    first = 2**level - 1
                    for k in range(first, 2 * first + 1):
                        rows = np.flatnonzero(node == k)
                        if len(rows) < 10:
                            continue
                        at = flat[rows].ravel()
                        gs = np.bincount(at, np.repeat(g[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                        hs = np.bincount(at, np.repeat(h[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                        ga, ha = gs[:, -1:], hs[:, -1:]
                        gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                        best = int(gain.argmax())
                        if gain.flat[best] > 1e-6:
                            f_[k], c_[k] = divmod(best, BINS)
                    node = 2 * node + 1 + (bins[np.arange(n), f_[node]] > c_[node])
                leaf = node - (2**DEPTH - 1)
                v = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
                scores[:, c] += v[leaf]
                feature.append(f_)
                cut.append(c_)
                value.append(v)
        return cls(edges, np.array(feature), np.array(cut), np.array(value))

    @staticmethod
    def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges[k], x[:, k]) for k in range(x.shape[1])], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the three states of each row."""
        bins = self.binned(x, self.edges)
        rows, s = np.arange(len(x)), np.zeros((len(x), 3))
        for t, (f, c, v) in enumerate(zip(self.feature, self.cut, self.value, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, f[node]] > c[node])
            s[:, t % 3] += v[node - (2**DEPTH - 1)]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


_BELOW = ((OUTSIDE, MAIN, CLUTTER), (MAIN, CLUTTER), (CLUTTER,))  # states that children may take


def decode(log_p: np.ndarray, parent: list[int]) -> list[int]:
    """The likeliest states of all nodes together that no ancestor contradicts; the root is outside."""
    n = len(parent)
    score = log_p.tolist()
    for k in range(n - 1, 0, -1):
        a, b, c = score[k]
        up = score[parent[k]]
        bc = b if b > c else c
        up[0] += a if a > bc else bc
        up[1] += bc
        up[2] += c
    state = [OUTSIDE] * n
    for k in range(1, n):
        s = score[k]
        state[k] = max(_BELOW[state[parent[k]]], key=s.__getitem__)
    return state


class _Composer:
    """Pages with known main nodes: many layouts, with and without telling elements and attributes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def prose(self, least: int, most: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(least, most)):
            w = "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 9)))
            out.append(w + (r.choice(".,") if r.random() < 0.12 else ""))
        return " ".join(out).capitalize() + r.choice((".", ".", ""))

    def attrs(self, *names: str, chance: float = 0.8) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names)
        name = r.choice((name, name, f"site-{name}", f"{name}-{r.choice(('box', 'wrap', 'area', '1', 'block'))}", f"page {name}"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, least: int, most: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.prose(1, 3)}</a>' for k in range(r.randint(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def clutter(self) -> str:
        r = self.r
        kind = r.randrange(11)
        if kind == 0:
            return f"<nav{self.attrs('nav', 'menu', chance=0.5)}>{self.links(3, 12)}</nav>" if r.random() < 0.6 else f"<div{self.attrs('menu', 'navbar', 'navigation')}>{self.links(3, 12)}</div>"
        if kind == 1:
            return f"<header{self.attrs('header', chance=0.4)}>{r.choice(('<h1>', '<div>'))}{self.prose(1, 8)}</header>"
        if kind == 2:
            return f"<footer>{self.prose(2, 25)}</footer>" if r.random() < 0.6 else f"<div{self.attrs('footer', 'copyright', 'legal')}>&copy; {self.prose(2, 30)}</div>"
        if kind == 3:
            inner = f"<h3>{self.prose(1, 4)}</h3>" + (self.links(3, 8) if r.random() < 0.6 else f"<p>{self.prose(5, 40)}</p>")
            return f"<aside{self.attrs('sidebar', chance=0.5)}>{inner}</aside>" if r.random() < 0.6 else f"<div{self.attrs('sidebar', 'widget', 'related', 'rail')}>{inner}</div>"
        if kind == 4:
            return f"<div{self.attrs('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', chance=1)}>{self.prose(2, 40)}</div>"
        if kind == 5:
            body = f"<p>{self.prose(5, 40)}</p>" if r.random() < 0.5 else self.prose(5, 40)
            return f"<div{self.attrs('cookie', 'notice', 'consent', 'alert', chance=1)}>{body}<button>{self.prose(1, 2)}</button></div>"
        if kind in (6, 7):
            tag, item = r.choice((("div", "div"), ("section", "article"), ("ul", "li"), ("section", "div"), ("div", "p")))
            many = "".join(f"<{item}{self.attrs('comment', 'reply', chance=0.7)}>" + (f"<p>{self.prose(5, 70)}</p>" if r.random() < 0.5 and item != "p" else self.prose(5, 70)) + f"</{item}>" for _ in range(r.randint(1, 6)))
            head = f"<h2>{self.prose(1, 3)}</h2>" if r.random() < 0.5 else ""
            return f"<{tag}{self.attrs('comments', 'discussion', 'replies', 'respond', chance=1)}>{head if tag != 'ul' else ''}{many}</{tag}>"
        if kind == 8:
            return f"<form action='/s'{self.attrs('search', 'login', 'newsletter', 'subscribe', chance=0.6)}><label>{self.prose(1, 5)}</label><input name=q><p>{self.prose(2, 15)}</p><button>{self.prose(1, 2)}</button></form>"
        if kind == 9:
            return f"<div{self.attrs('share', 'social', 'related', 'breadcrumb', 'tags', 'pagination', chance=1)}>{self.links(2, 7)}</div>"
        return f"<section{self.attrs('related', 'recommended', 'popular', 'newsletter', chance=1)}><h2>{self.prose(1, 4)}</h2>{self.links(2, 6) if r.random() < 0.6 else '<p>' + self.prose(5, 30) + '</p>'}</section>"

    def inside(self) -> str:
        r = self.r
        out = [f"<h{r.choice((1, 1, 2))}>{self.prose(2, 18)}</h1>".replace("</h1>", "") + ("</h1>" if r.random() < 0.9 else "")] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.72:
                text = self.prose(3, 140)
                text = f"<b>{text}.<br>" if r.random() < 0.15 else f"<em>{text}</em>" if r.random() < 0.05 else text
                out.append(f"<p{self.attrs('text', chance=0.08)}>{text}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{self.prose(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<h2>{self.prose(1, 8)}</h2>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{self.prose(5, 50)}</p></blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.prose(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                out.append(f"<div>{self.prose(5, 60)}</div>")
            elif kind < 0.95:
                out.append(f"<pre>{self.prose(3, 20)}</pre>")
            else:
                out.append(f"<!--x-->{self.clutter()}<!--y-->")
        return "".join(out)

    def page(self) -> str:
        """Clutter stands outside the marks <!--m--> and <!--/m-->, or within it between <!--x--> and <!--y-->."""
        r = self.r
        tag, named = r.choice((("article", 0.3), ("article", 0.3), ("main", 0.3), ("div", 1.0), ("div", 1.0), ("section", 1.0), ("div", 0.5)))
        main = f"<!--m--><{tag}{self.attrs('content', 'article', 'post', 'entry', 'story', 'main', chance=named)}>{self.inside()}</{tag}><!--/m-->"
        before = [self.clutter() for _ in range(r.randint(0, 4))]
        after = [self.clutter() for _ in range(r.randint(0, 4))]
        body = "".join([*before, main, *after])
        if r.random() < 0.5:
            body = f"<div{self.attrs('wrapper', 'container', 'page', 'layout', chance=0.9)}>{body}</div>"
        if r.random() < 0.4:
            body = self.clutter() + body + self.clutter()
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 8)}</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def _states(html: str) -> tuple[Page, list[int]]:
    """A composed page and the state of each of its nodes, by the marks between which the node's tag stands."""
    cuts = [(m.start(), m[0]) for m in re.finditer(r"<!--/?[mxy]-->", html)]
    sections, at, state = [], 0, CLUTTER
    for where, mark in cuts:
        sections.append((state, html[at:where]))
        at, state = where + len(mark), MAIN if mark in ("<!--m-->", "<!--y-->") else CLUTTER
    sections.append((state, html[at:]))
    page = _Told("".join(re.sub(r"<([a-z][a-z0-9]*)(?=[\s>])", rf'<\1 data-s="{s}"', part) for s, part in sections))
    holds = [s == MAIN and not g for s, g in zip(page.state, page.gone, strict=True)]
    for k in range(len(holds) - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    return page, [OUTSIDE if s == CLUTTER and held else s for s, held in zip(page.state, holds, strict=True)]


class _Told(Page):
    def __init__(self, html: str):
        self.state = [CLUTTER]
        super().__init__(html)

    def _add(self, tag: str, parent: int, attrs: str) -> None:
        super()._add(tag, parent, attrs)
        m = re.search(r'data-s="(\d)"', attrs)
        self.state.append(int(m[1]) if m else self.state[parent])


@lru_cache(1)
def fitted() -> Trees:
    """The trees, fitted on PAGES composed pages; the same everywhere."""
    xs, ys = [], []
    composer = _Composer(11)
    for _ in range(PAGES):
        page, state = _states(composer.page())
        keep = ~np.array(page.gone)
        xs.append(features(page)[keep])
        ys.append(np.array(state)[keep])
    return Trees.fit(np.concatenate(xs), np.concatenate(ys))


def extract(htmls: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    log_p = trees.log_odds(np.concatenate(rows))
    out, at = [], 0
    for page, x in zip(pages, rows, strict=True):
        out.append(page.text(decode(log_p[at : at + len(x)], page.parent)))
        at += len(x)
    return out


def main_text(pages: DataFrame, column: str = "html", trees: Trees | None = None) -> DataFrame:
    """pages with `main_text` string and `main_chars` long (its code points) in place of the html column.

    Null and empty pages, and pages without main nodes, give an empty text. Rows pass through one by one; an empty table
    gives an empty result; input columns of the new names are replaced.
    """
    from pyspark.sql import types as T

    pages = pages.drop("main_text", "main_chars")
    shared = pages.sparkSession.sparkContext.broadcast(trees or fitted())  # ROUNDS trees a state
    names, at = pages.columns, pages.columns.index(column)
    rest = [n for n in names if n != column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, column, 1 << 20):
            text = extract(b.column(at).to_pylist(), shared.value)
            others = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.record_batch([*others, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*rest, "main_text", "main_chars"])

    kept = [f for f in pages.schema.fields if f.name != column]
    return _store.batched(pages).mapInArrow(run, T.StructType([*kept, T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType())]))
