"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every block element is a node with one of three labels: boilerplate, content, or mixed (it holds both, such as
``body``).  A hidden Markov tree joins them: a potential for each (label of parent, label of child), and a potential of
each node from what can be seen of it - tag, words of class, id and role, length of its own text, share of links.
Sum-product messages go up from the leaves and down from the root and give every node's marginals.  Text whose node is
content with a marginal over one half is the main text.

The model's counts come from labelled pages; ``labelled_pages`` writes such pages in many layouts, and ``fit`` takes
any others as well.  Messages run level by level over all pages of a batch at once.

Scripts, styles, comments and other things that a reader never sees aren't nodes.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by one space.  Null and empty pages give an empty
text; broken markup is read as browsers do where that matters for blocks.  Ties of a marginal are boilerplate.  A page
is one row and one task's work; repeated rows get equal values.  Other columns are left alone.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import for_workers

BOILERPLATE, CONTENT, MIXED = 0, 1, 2

#: A comment, an end tag, a start tag, a declaration, or what is left of one at the end of the page.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|x-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Elements whose content isn't markup, and those that no reader sees.
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
UNSEEN = {"head", "script", "style", "template", "iframe", "noembed", "noframes", "textarea", "title", "svg", "math", "object", "select", "button", "noscript", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Start tags that close an open element of the kinds named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Where the search for such an element ends.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Bounds of the steps in which a node's own text and its share of links are seen.
LENGTHS = (1, 20, 60, 160)
DENSITIES = (0.01, 0.25, 0.6)


@dataclass
class Tree:
    """The block elements of a page in the order of their start tags, and its text segments."""

    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    marked: list[int | None] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # characters of text right under the element
    linked: list[int] = field(default_factory=list)
    segments: list[tuple[int, str]] = field(default_factory=list)

    labelled: bool = False

    def add(self, parent: int, tag: str, attributes: str) -> int:
        tokens, label = [], None
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "x-label":
                    label = int(value) if self.labelled and value in ("0", "1", "2") else None
                else:
                    tokens += [t for t in re.split(r"[^a-z]+", value.lower()) if t]
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.marked.append(label)
        self.own.append(0)
        self.linked.append(0)
        return len(self.parents) - 1


def parse(page: str, labelled: bool = False) -> Tree:
    """The tree of a page's block elements; inline elements belong to the block around them.

    ``labelled``: ``x-label`` attributes are read.  Open elements are looked up by their tag, so that time is linear in
    the page whatever is nested in it.
    """
    tree = Tree(labelled=labelled)
    stack = [(tree.add(-1, "#root", ""), "#root")]  # (node, tag); inline and unseen elements keep the node around them
    spots: dict[str, list[int]] = {}  # where in the stack a tag is open
    blocks = [0]  # where elements are open that aren't inline
    links = unseen = 0
    pending: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                tree.segments.append((stack[-1][0], text))

    def say(raw: str) -> None:
        if unseen or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pending.append(text)
        n = len(text) - text.count(" ")
        node = stack[-1][0]
        tree.own[node] += n
        if links:
            tree.linked[node] += n

    def push(node: int, tag: str) -> None:
        spots.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((node, tag))

    def innermost(tags: set[str]) -> int:
        return max((at[-1] for t in tags if (at := spots.get(t))), default=0)

    def pop() -> None:
        nonlocal links, unseen
        _, tag = stack.pop()
        spots[tag].pop()
        if tag not in INLINE:
            blocks.pop()
        links -= tag == "a"
        unseen -= tag in UNSEEN

    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        end, start = m[1], m[2] or m[4]
        if end:
            tag = end.lower()
            if tag == "br":
                pending.append(" ")
            depth = innermost({tag})
            if depth and not (tag in INLINE and blocks[-1] > depth):
                if tag not in INLINE:
                    flush()
                while len(stack) > depth:
                    pop()
        elif start:
            tag = start.lower()
            attributes = m[3] or m[5] or ""
            if tag in VOID:
                pending.append(" " if tag in ("br", "hr") else "")
                if tag == "hr":
                    flush()
                continue
            if tag not in INLINE and tag not in UNSEEN:
                flush()
                # A block ends an open paragraph, however many inline elements are open in it.
                k = blocks[-1]
                if k > 0 and stack[k][1] == "p":
                    while len(stack) > k:
                        pop()
                if tag in CLOSES:
                    k = innermost(CLOSES[tag] | SCOPES[tag])
                    if k > 0 and stack[k][1] in CLOSES[tag]:
                        while len(stack) > k:
                            pop()
                push(stack[-1][0] if unseen else tree.add(stack[-1][0], tag, attributes), tag)
            else:
                if tag == "body" or (tag == "head" and unseen):
                    continue
                push(stack[-1][0], tag)
                links += tag == "a"
                unseen += tag in UNSEEN
            if attributes.endswith("/") and tag in ("svg", "math", "object", "iframe"):
                pop()
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if tag not in UNSEEN:
                    say(page[at : close.start() if close else size])
                at = close.start() if close else size
            elif tag == "body" and unseen:  # a head that was never closed
                while unseen:
                    pop()
    flush()
    return tree


def features(tree: Tree) -> list[list[tuple]]:
    """What the model sees of each node: a list of discrete features."""
    below, linked = list(tree.own), list(tree.linked)
    for k in range(len(below) - 1, 0, -1):
        below[tree.parents[k]] += below[k]
        linked[tree.parents[k]] += linked[k]
    out = []
    for k, tag in enumerate(tree.tags):
        length = sum(tree.own[k] >= x for x in LENGTHS)
        density = sum(linked[k] / below[k] >= x for x in DENSITIES) if below[k] else -1
        bare = "" if tree.tokens[k] else "."
        above = tree.tags[tree.parents[k]] if k else ""
        out.append([("tag", tag + bare, density), ("own", length, density), ("under", above, tag + bare), *{("word", w) for w in tree.tokens[k]}])
    return out


@dataclass
class Model:
    """Log potentials: of features for each label, of (label of parent, label of child), and of the root's label."""

    unary: dict[tuple, tuple[float, float, float]]
    unseen: dict[str, tuple[float, float, float]]
    pair: np.ndarray
    root: np.ndarray

    def node(self, found: list[tuple]) -> tuple[float, float, float]:
        a = b = c = 0.0
        for f in found:
            x = self.unary.get(f) or self.unseen[f[0]]
            a, b, c = a + x[0], b + x[1], c + x[2]
        return a, b, c


def fit(pages: list[str]) -> Model:
    """Counts over labelled pages: ``x-label`` on an element labels it and what is below it, up to another mark."""
    pair, root = np.ones((3, 3)), np.ones(3)
    pair[BOILERPLATE] = (200, 0.2, 0.2)  # what is inside boilerplate or content is rarely anything else
    pair[CONTENT] = (1, 20, 0.2)
    seen: dict[tuple, list[float]] = {}
    totals: dict[str, list[float]] = {}
    kinds: Counter = Counter()
    for page in pages:
        tree = parse(page, labelled=True)
        labels: list[int] = []
        for k, mark in enumerate(tree.marked):
            labels.append(mark if mark is not None else labels[tree.parents[k]] if k else MIXED)
        root[labels[0]] += 1
        for k, found in enumerate(features(tree)):
            if k:
                pair[labels[tree.parents[k]], labels[k]] += 1
            for f in found:
                if f not in seen:
                    seen[f] = [0.0] * 3
                    kinds[f[0]] += 1
                seen[f][labels[k]] += 1
                totals.setdefault(f[0], [0.0] * 3)[labels[k]] += 1

    def log(counts: list[float], kind: str) -> tuple[float, float, float]:
        return tuple(float(np.log((n + 0.5) / (t + 0.5 * (kinds[kind] + 1)))) for n, t in zip(counts, totals[kind], strict=True))

    unary = {f: log(n, f[0]) for f, n in seen.items()}
    for f in unary:  # a word says whether it is like boilerplate or content; nodes without words mustn't gain from that
        if f[0] == "word":
            top = max(unary[f])
            unary[f] = tuple(x - top for x in unary[f])
    unseen = {kind: (0.0, 0.0, 0.0) for kind in kinds}
    return Model(unary, unseen, np.log(pair / pair.sum(axis=1, keepdims=True)), np.log(root / root.sum()))


def _sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=-1)) + top[..., 0]


def marginals(model: Model, unary: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Label marginals of all nodes of a forest by sum-product, up and then down."""
    order = np.argsort(depths, kind="stable")
    edges = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    levels = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    up = unary.copy()  # own potential and the messages of the children
    message = np.zeros_like(unary)
    for nodes in reversed(levels[1:]):
        message[nodes] = _sum(model.pair[None] + up[nodes][:, None, :])
        np.add.at(up, parents[nodes], message[nodes])
    belief = up.copy()
    belief[levels[0]] += model.root
    for nodes in levels[1:]:
        rest = belief[parents[nodes]] - message[nodes]
        belief[nodes] += _sum(model.pair.T[None] + rest[:, None, :])
    belief -= belief.max(axis=1, keepdims=True)
    share = np.exp(belief)
    return share / share.sum(axis=1, keepdims=True)


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    base = np.cumsum([0] + [len(t.parents) for t in trees])
    unary = np.array([model.node(f) for t in trees for f in features(t)])
    parents = np.concatenate([np.array(t.parents) + b for t, b in zip(trees, base, strict=False)])
    content = marginals(model, unary, parents, np.concatenate([t.depths for t in trees]))[:, CONTENT] > 0.5
    return [" ".join(text for node, text in t.segments if content[b + node]) for t, b in zip(trees, base, strict=False)]


# Labelled pages


def labelled_pages(count: int = 1000, seed: int = 11) -> list[str]:
    """Pages in many layouts whose regions are labelled by ``x-label``: 0 boilerplate, 1 content, 2 both."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick("bcdfglmnprstv") + pick("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def links(n: int, wrap: str = "li") -> str:
        items = "".join(f'<{wrap}><a href="/{k}">{words(1, 3)}</a></{wrap}>' for k in range(n))
        return f"<ul>{items}</ul>" if wrap == "li" else items

    def name(*options: str) -> str:
        return f' {pick(("class", "id"))}="{pick(options)}"'

    def zero(tag: str, inside: str, attributes: str = "") -> str:
        return f'<{tag}{attributes} x-label="0">{inside}</{tag}>'

    def menu() -> str:
        return pick((lambda: zero("nav", links(rng.randint(3, 9))), lambda: zero("div", links(rng.randint(3, 9)), name("menu", "main-menu", "navbar", "navigation", "top-nav", "breadcrumb")), lambda: zero("ul", "".join(f'<li><a href="/">{words(1, 2)}</a></li>' for _ in range(5)), name("menu", "nav"))))()

    def top() -> str:
        inside = pick((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", f"<div>{words(1, 5)}</div>")) + pick(("", links(4)))
        return pick((zero("header", inside), zero("div", inside, name("header", "site-header", "page-header", "masthead", "top-bar"))))

    def bottom() -> str:
        inside = pick((f"&copy; {words(3, 14)}", f"<p>{words(3, 20)}</p>", f"<p>{words(3, 20)}</p>{links(4)}"))
        return pick((zero("footer", inside), zero("footer", inside), zero("div", inside, name("footer", "site-footer", "page-footer", "copyright", "bottom"))))

    def side() -> str:
        inside = pick((f"<h3>{words(1, 3)}</h3>{links(5)}", f"<p>{words(5, 40)}</p>", f"<div><p>{words(5, 30)}</p></div>"))
        return pick((zero("aside", inside), zero("div", inside, name("sidebar", "side-bar", "right-column", "widget", "related", "related-posts", "recommended"))))

    def advert() -> str:
        return zero(pick(("div", "div", "aside", "section")), pick((words(3, 25), f"<p>{words(4, 30)}</p>")), name("ad", "ads", "advert", "advertisement", "ad-banner", "promo", "sponsored", "banner-ad"))

    def notice() -> str:
        inside = pick((words(8, 40), words(5, 30), f"<p>{words(8, 40)}</p><a href='/'>{words(1, 2)}</a>"))
        return zero("p" if rng.random() < 0.3 and "<p>" not in inside else pick(("div", "section")), inside, name("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "cookie-banner", "privacy-notice", "popup", "modal", "overlay"))

    def form() -> str:
        inside = f"<label>{words(1, 3)}</label><input name=q>{pick(('', f'<p>{words(4, 20)}</p>'))}<button>{words(1, 2)}</button>"
        return pick((zero("form", inside), zero("div", f"<p>{words(3, 15)}</p><form>{inside}</form>", name("newsletter", "subscribe", "signup", "search", "login", "contact-form"))))

    def comments() -> str:
        one = lambda: pick((f'<div class="comment"><p>{words(5, 60)}</p></div>', f"<li><p>{words(5, 60)}</p></li>", f'<article class="comment"><p>{words(5, 50)}</p></article>', f"<p>{words(5, 60)}</p>"))
        inside = pick(("", f"<h2>{words(1, 3)}</h2>")) + "".join(one() for _ in range(rng.randint(1, 6)))
        return zero(pick(("section", "div", "ol")), inside, name("comments", "comment-list", "user-comments", "reader-comments", "responses", "discussion", "disqus", "comment-section"))

    def share() -> str:
        return zero("div", links(4, "span"), name("share", "social", "social-links", "tags", "toolbar"))

    def paragraph() -> str:
        text = words(1, 12) if rng.random() < 0.3 else words(12, 140)
        if rng.random() < 0.25:
            text = f'{text} <a href="/x">{words(1, 3)}</a> {words(1, 20)}'
        if rng.random() < 0.15:
            return f"<p><b>{text}<br>"
        return f"<p>{pick((text, text, f'<em>{text}</em>'))}</p>"

    def piece() -> str:
        x = rng.random()
        if x < 0.78:
            return paragraph()
        return pick((f"<h2>{words(1, 6)}</h2>", f"<h3>{words(1, 6)}</h3>", f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(4))}</ul>", f"<ol>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(3))}</ol>", f"<blockquote><p>{words(5, 60)}</p></blockquote>", f"<pre>{words(5, 40)}</pre>", f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(2, 15)}</figcaption></figure>", f"<div>{words(5, 60)}</div>", f"<section><h2>{words(1, 4)}</h2><p>{words(10, 80)}</p></section>"))

    def article() -> str:
        body = [piece() for _ in range(rng.randint(0, 14))]
        title = pick((f"<h1>{words(1, 10)}</h1>", f"<h1>{words(1, 10)}</h1>", f"<header><h1>{words(1, 10)}</h1></header>", f"<h2>{words(1, 10)}</h2>"))
        for extra, chance in ((advert, 0.3), (share, 0.15), (form, 0.1), (side, 0.1)):
            if rng.random() < chance:
                body.insert(rng.randint(0, len(body)), extra())
        inside = title + "".join(body)
        x = rng.random()
        if x < 0.55:
            return f'<article{pick(("", name("post", "article", "entry", "story")))} x-label="1">{inside}</article>'
        if x < 0.75:
            return f'<main x-label="1">{inside}</main>'
        return f'<div{name("content", "main-content", "post-content", "article-body", "entry-content", "story", "post", "text", "main")} x-label="1">{inside}</div>'

    def page() -> str:
        before = [f() for f, chance in ((notice, 0.25), (top, 0.5), (menu, 0.8), (advert, 0.5), (form, 0.15), (side, 0.15)) if rng.random() < chance]
        after = [f() for f, chance in ((share, 0.1), (comments, 0.45), (side, 0.35), (form, 0.2), (advert, 0.15), (notice, 0.15)) if rng.random() < chance]
        end = [bottom()] if rng.random() < 0.9 else []
        middle = article()
        if rng.random() < 0.25:
            middle = f'<{(t := pick(("div", "main", "section")))} x-label="2"{pick(("", name("wrapper", "container", "page", "layout", "row")))}>{middle}{"".join(after)}</{t}>'
            after = []
        close = "</body></html>" if rng.random() < 0.9 else ""
        return f'<!DOCTYPE html><html x-label="2"><head><title>{words(1, 5)}</title></head><body x-label="2">{"".join(before)}{middle}{"".join(after)}{"".join(end)}{close}'

    return [page() for _ in range(count)]


_FITTED: list[Model] = []


def fitted() -> Model:
    if not _FITTED:
        _FITTED.append(fit(labelled_pages()))
    return _FITTED[0]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.  No shuffle; one pass over the input."""
    for_workers(pages.sparkSession)
    model = model or fitted()
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(model, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
