"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable: content or not. Its tag, names, text and links
give its own potential; each pair of parent and child has a potential that depends on
what kind of element the child is. Sum-product messages, first from the leaves up and
then from the root down, give every element's marginal, and text belongs to the
content if the element that holds it does. So a paragraph is judged by the comment
list or the article around it as much as by itself.

The potentials are trained by maximum likelihood on labelled pages: layouts with
known content, written out by ``labelled_pages``. All pages of a batch are one forest;
messages run level by level in numpy.

A null or empty html gives an empty text, as does a page without content. Elements
left open, or closed without being open, are handled as browsers do in the common
cases; a head ends with the first thing it may not hold, and a button, menu of options,
drawing or the like that is never closed ends with the element around it or at the
next block. Pages nest as deep as they like. Repeated rows are extracted each; other
columns do not matter.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do.
NO_TEXT = frozenset(
    "script style noscript template head title svg iframe object canvas audio video"
    " select textarea button datalist".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol"
    " p pre section summary table ul".split()
)
#: An opening tag closes an open element of these, up to the given ancestors.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A paragraph outside of these is not closed from within.
P_SCOPES = frozenset("table td th button object".split())
#: All that a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An opening tag of these ends an element without text that is left open.
BLOCKS = CLOSES_P | frozenset("body li dt dd tr td th tbody".split())

# What kind of child an element is; each kind has its own pair potential.
KINDS = {
    "article": 1, "main": 1,
    "nav": 2, "aside": 2, "footer": 2, "header": 2, "form": 2, "menu": 2, "dialog": 2,
    "div": 3, "section": 3, "table": 3, "tbody": 3, "tr": 3, "td": 3, "center": 3,
    "p": 4, "blockquote": 4, "pre": 4, "ul": 4, "ol": 4, "dl": 4, "figure": 4,
    "li": 5, "dt": 5, "dd": 5, "figcaption": 5, "th": 5,
    "h1": 6, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6,
}
N_KINDS = 8
#: Kinds that mostly hold other elements; text of their own says something about them.
HOLDERS = (0, 1, 3)
FEATURES = 4096
ROUNDS = 150
TRAINING_PAGES = 1000
SEED = 42


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: str = ""
    content: bool = False
    #: the element whose text this one's text goes on: itself unless it is inline
    block: int = 0
    #: paragraphs open around it, up to the next scope
    paragraphs: int = 0
    n_own: int = 0
    n_chars: int = 0
    n_linked: int = 0
    n_links: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (element, block element, text) in page order
    texts: list[tuple[int, int, str]] = field(default_factory=list)


class _Events(HTMLParser):
    """Tags and texts of a page in order: (kind, tag or text, attributes)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, list]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.events.append(("end", tag, []))

    def handle_data(self, data):
        self.events.append(("text", data, []))


def skips(events: list[tuple[str, str, list]]) -> dict[int, int]:
    """For the start of each element without text, the first event after it.

    An end tag closes what it opened and all left open within. An element that is
    closed by its own end tag is left out whole; one left open ends with the element
    around it or before the next block, whichever comes first.
    """
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    after: dict[int, int] = {}
    left_open: list[tuple[int, int]] = []
    head: int | None = None

    def close(depth: int, at: int, own: bool = False):
        while len(stack) > depth:
            tag, start = stack.pop()
            opened[tag] -= 1
            if tag in NO_TEXT:
                if own and len(stack) == depth:
                    after[start] = at + 1
                else:
                    left_open.append((start, at))

    for at, (kind, tag, _) in enumerate(events):
        if kind == "start":
            if tag == "head":
                head = len(stack)
                continue
            if head == len(stack) and tag not in IN_HEAD:
                head = None
            if tag in ("button", "select") and opened.get(tag):
                close(max(i for i, (t, _) in enumerate(stack) if t == tag), at)
            if tag not in VOID:
                stack.append((tag, at))
                opened[tag] = opened.get(tag, 0) + 1
        elif kind == "end":
            if tag == "head":
                if head is not None:
                    close(head, at)
                head = None
            elif tag in ("body", "html"):
                close(0, at)
            elif opened.get(tag):
                for depth in range(len(stack) - 1, -1, -1):
                    here = stack[depth][0]
                    if here == tag:
                        close(depth, at, own=True)
                        break
                    if (tag in INLINE and here not in INLINE) or (tag == "p" and here in NO_TEXT):
                        break
    close(0, len(events))
    blocks = [i for i, (kind, tag, _) in enumerate(events) if kind == "start" and tag in BLOCKS]
    for start, end in left_open:
        block = bisect_right(blocks, start)
        after[start] = min(end, blocks[block]) if block < len(blocks) else end
    return after


class _Builder:
    """Elements and texts of a page; elements that hold no text are left out whole."""

    def __init__(self):
        self.page = Page([Node("#page", -1, 0)])
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.in_head = False

    def build(self, events: list[tuple[str, str, list]]) -> Page:
        after = skips(events)
        at = 0
        while at < len(events):
            kind, value, attrs = events[at]
            if kind == "text":
                self.handle_data(value)
            elif kind == "end":
                self.handle_endtag(value)
            else:
                self.handle_starttag(value, attrs)
                if at in after:
                    at = after[at]
                    continue
            at += 1
        return self.page

    def handle_starttag(self, tag, attrs):
        nodes = self.page.nodes
        if tag == "head":
            # in a body it means nothing
            self.in_head = all(n.tag in ("#page", "html") for n in nodes)
            return
        if self.in_head:
            if tag in IN_HEAD or tag == "html":
                return
            self.in_head = False
        if tag in CLOSES_P and nodes[self.stack[-1]].paragraphs:
            self._close({"p"}, P_SCOPES)
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag][0]):
            self._close(*CLOSES[tag])
        if tag in NO_TEXT:
            return
        if tag in ("br", "hr", "img", "wbr") or tag in VOID:
            if tag in ("br", "hr"):
                self._text(" ")
            return
        if tag in ("html", "body") and any(nodes[i].tag == tag for i in self.stack):
            return
        parent = self.stack[-1]
        names = " ".join(
            f"{v}" for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v
        )
        if any(k == "hidden" for k, _ in attrs):
            names += " hidden"
        content = any(k == "data-content" for k, _ in attrs)
        number, above = len(nodes), nodes[parent]
        block = above.block if tag in INLINE and parent else number
        paragraphs = 0 if tag in P_SCOPES else above.paragraphs + (tag == "p")
        nodes.append(Node(tag, parent, above.depth + 1, names, content, block, paragraphs))
        self.stack.append(number)
        self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag in ("head", "body", "html"):
            self.in_head = False
            return
        if self.in_head:
            return
        if not self.open[tag]:
            return
        nodes = self.page.nodes
        for at in range(len(self.stack) - 1, 0, -1):
            here = nodes[self.stack[at]].tag
            if here == tag:
                self._pop(at)
                return
            if tag in INLINE and here not in INLINE:
                return

    def handle_data(self, data):
        if self.in_head:
            if not data.strip():
                return
            self.in_head = False
        self._text(data)

    def _pop(self, at):
        self.open.subtract(self.page.nodes[i].tag for i in self.stack[at:])
        del self.stack[at:]

    def _close(self, tags, within):
        nodes = self.page.nodes
        for at in range(len(self.stack) - 1, 0, -1):
            here = nodes[self.stack[at]].tag
            if here in tags:
                self._pop(at)
                if tags == {"p"} or here in ("li", "dt", "dd", "option"):
                    return
            elif here in within:
                return

    def _text(self, data):
        element = self.stack[-1]
        self.page.texts.append((element, self.page.nodes[element].block, data))


def parse(html: str | None) -> Page:
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    page = _Builder().build(parser.events)
    linked = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes[1:], 1):
        linked[i] = node.tag == "a" or linked[node.parent]
    for element, _, text in page.texts:
        n = len(text.strip())
        page.nodes[element].n_chars += n
        page.nodes[page.nodes[element].block].n_own += n
        page.nodes[element].n_linked += n if linked[element] else 0
    for i, node in enumerate(page.nodes):
        node.n_links += node.tag == "a"
    for node in reversed(page.nodes[1:]):
        parent = page.nodes[node.parent]
        parent.n_chars += node.n_chars
        parent.n_linked += node.n_linked
        parent.n_links += node.n_links
    return page


_NAME = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 16)
def _names(names: str) -> tuple[int, ...]:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", names)
    return tuple(sorted({_slot("name", w) for w in _NAME.findall(spaced.lower())}))


@lru_cache(maxsize=1 << 16)
def _slot(*feature: object) -> int:
    return zlib.crc32(repr(feature).encode()) % FEATURES


def features(page: Page) -> tuple[list[int], list[int]]:
    """(element, feature) of a page."""
    elements: list[int] = []
    slots: list[int] = []
    for i, node in enumerate(page.nodes):
        parent = page.nodes[node.parent].tag if i else ""
        share = node.n_linked / node.n_chars if node.n_chars else 0.0
        found = [
            _slot("tag", node.tag),
            _slot("under", parent, node.tag in INLINE, KINDS.get(node.tag, 0)),
            _slot("length", min(12, node.n_chars.bit_length()), node.tag in HEADINGS),
            _slot("linked", int(4 * share), min(3, node.n_links)),
            _slot("own", min(9, node.n_own.bit_length()) if KINDS.get(node.tag, 0) in HOLDERS else -1),
            *_names(node.names),
        ]
        elements += [i] * len(found)
        slots += found
    return elements, slots


class Forest:
    """Pages as one forest: parents, kinds and features of all elements, level by level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.nodes) for p in pages])
        self.first = np.cumsum(sizes) - sizes
        parent, kind, depth, element, slot = [], [], [], [], []
        for offset, page in zip(self.first.tolist(), pages):
            parent += [n.parent + offset if n.parent >= 0 else -1 for n in page.nodes]
            kind += [7 if n.tag in INLINE else KINDS.get(n.tag, 0) for n in page.nodes]
            depth += [n.depth for n in page.nodes]
            e, s = features(page)
            element += [x + offset for x in e]
            slot += s
        self.parent, self.kind = np.array(parent), np.array(kind)
        self.element, self.slot = np.array(element), np.array(slot)
        depths = np.array(depth)
        order = np.argsort(depths, kind="stable")
        cuts = np.searchsorted(depths[order], np.arange(depths.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        self.size = len(parent)

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all elements, and joint marginals of all (parent, child) states.

        ``weight`` holds one number per feature, ``pair`` the log potentials by kind
        of child, state of the parent and state of the child.
        """
        own = np.zeros((self.size, 2))
        own[:, 1] = np.bincount(self.element, weight[self.slot], self.size)
        below = own.copy()  # own potential and messages from the children
        up = np.zeros((self.size, 2))  # message to the parent, by the parent's state
        for level in reversed(self.levels[1:]):
            joint = pair[self.kind[level]] + below[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            if len(level) * 8 > self.size:
                for state in (0, 1):
                    below[:, state] += np.bincount(self.parent[level], up[level, state], self.size)
            else:
                np.add.at(below, self.parent[level], up[level])
        belief = below.copy()
        both = np.zeros((self.size, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - up[level]
            joint = pair[self.kind[level]] + below[level][:, None, :] + above[:, :, None]
            top = joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint - top)
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            both[level] = joint
            child = np.log(joint.sum(axis=1) + 1e-300)
            belief[level] = child
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True))[:, 1], both


@dataclass
class Model:
    weight: np.ndarray
    pair: np.ndarray


def train(pages: list[Page]) -> Model:
    """Maximum likelihood: what is observed less what the marginals expect, by Adam.

    Pair potentials are those of a child given its parent, so a child that tells nothing
    by itself says nothing about its parent, however many there are of its kind.
    """
    forest = Forest(pages)
    state = np.array([n.content for p in pages for n in p.nodes], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    observed_pair = np.zeros((N_KINDS, 2, 2))
    np.add.at(
        observed_pair, (forest.kind[child], state[forest.parent[child]], state[child]), 1.0
    )
    model = Model(np.zeros(FEATURES), np.zeros((N_KINDS, 2, 2)))
    free = np.zeros((N_KINDS, 2, 2))
    parameters = [model.weight, free]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, ROUNDS + 1):
        model.pair = free - np.logaddexp(free[:, :, 0], free[:, :, 1])[:, :, None]
        p, both = forest.marginals(model.weight, model.pair)
        expected_pair = np.zeros_like(observed_pair)
        np.add.at(expected_pair, forest.kind[child], both[child])
        gap = (state - p)[forest.element]
        given = observed_pair - expected_pair
        gradients = [
            np.bincount(forest.slot, gap, FEATURES) - 0.5 * model.weight,
            given - np.exp(model.pair) * given.sum(axis=2, keepdims=True) - 0.5 * free,
        ]
        for value, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return model


def extract(pages: list[Page], model: Model) -> list[str]:
    """Content of some pages: blocks in page order, two line breaks between them."""
    forest = Forest(pages)
    content = forest.marginals(model.weight, model.pair)[0] > 0.5
    out = []
    for offset, page in zip(forest.first.tolist(), pages):
        blocks: list[tuple[int, list[str]]] = []
        for element, block, text in page.texts:
            if content[offset + element]:
                if not blocks or blocks[-1][0] != block:
                    blocks.append((block, []))
                blocks[-1][1].append(text)
        joined = (" ".join("".join(parts).split()) for _, parts in blocks)
        out.append("\n\n".join(b for b in joined if b))
    return out


class _Writer:
    """Writes labelled pages: random layouts whose content is marked ``data-content``."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        n = rng.randint(low, high)
        text = " ".join(
            "".join(rng.choice("etaoinshrdlcumwf") for _ in range(rng.randint(2, 9))) for _ in range(n)
        )
        return text.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def tag(self, tag: str, inside: str, content: bool, names: str = "") -> str:
        mark = " data-content" if content else ""
        if names:
            mark += f' {self.rng.choice(["class", "class", "id"])}="{names}"'
        return f"<{tag}{mark}>{inside}</{tag}>"

    def some(self, names: str) -> str:
        """One of some names, at times with another word, at times none."""
        name = self.rng.choice(names.split())
        extra = self.rng.choice(["", "", "box", "wrap", "area", "block", "inner", "top", "left"])
        return self.rng.choice([name, name, f"{name}-{extra}".strip("-"), f"site-{name}", f"{extra} {name}".strip()])

    def links(self) -> str:
        items = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(2, 9))]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " ".join(items)

    def paragraphs(self, content: bool, low: int, high: int) -> str:
        return "".join(
            self.tag("p", self.prose(content), content) for _ in range(self.rng.randint(low, high))
        )

    def prose(self, content: bool) -> str:
        rng = self.rng
        parts = []
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = self.words(1, rng.choice([3, 12, 60, 150]))
            if rng.random() < 0.25:
                text = self.tag(rng.choice("b i em strong a span code a".split()), text, content)
            parts.append(text)
        return rng.choice([" ", " ", "<br>"]).join(parts)

    def junk(self) -> str:
        rng = self.rng
        kind = rng.choice("ad notice share related form crumbs aside comments tags".split())
        if kind == "ad":
            return self.tag(rng.choice(["div", "div", "aside", "section", "p", "span"]), self.words(2, 30), False, self.some("ad ads advert advertisement sponsored promo banner sponsor promotion adsense advertising"))
        if kind == "notice":
            return self.tag(rng.choice(["div", "section", "p", "aside"]), self.words(4, 40), False, self.some("cookie notice consent alert gdpr privacy warning popup modal message disclaimer subscribe paywall cookies"))
        if kind == "share":
            return self.tag("div", self.links(), False, self.some("share social sharing follow buttons toolbar"))
        if kind == "related":
            return self.tag(rng.choice(["div", "section", "aside"]), f"<h3>{self.words(1, 3)}</h3>" + self.links(), False, self.some("related recommended more popular trending teaser read"))
        if kind == "form":
            return f'<form action="/s"><label>{self.words(1, 4)}</label><input name="q">' + rng.choice(["", self.tag("p", self.words(3, 20), False)]) + f"<button>{self.words(1, 2)}</button></form>"
        if kind == "crumbs":
            return self.tag(rng.choice(["div", "nav", "ol"]), self.links(), False, self.some("breadcrumb breadcrumbs pagination pager path toc"))
        if kind == "aside":
            return self.tag("aside", self.paragraphs(False, 1, 3), False, rng.choice(["", self.some("sidebar widget note promo side secondary")]))
        if kind == "tags":
            return self.tag("div", self.links(), False, self.some("tags meta byline author categories info"))
        return self.comments()

    def comments(self) -> str:
        rng = self.rng
        one = lambda: self.tag(
            rng.choice(["div", "li", "article", "section"]),
            rng.choice(["", f"<b>{self.words(1, 2)}</b>", f"<h4>{self.words(1, 2)}</h4>"]) + self.paragraphs(False, 1, 3),
            False,
            rng.choice(["", self.some("comment reply response user post")]) if rng.random() < 0.8 else "comment",
        )
        many = "".join(one() for _ in range(rng.randint(1, 5)))
        return self.tag(rng.choice(["div", "section", "ul", "ol", "aside"]), rng.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + many, False, self.some("comments comments discussion responses disqus replies commentlist reviews reactions"))

    def bare(self) -> str:
        """Text without elements of its own, as old pages and plain templates have it."""
        rng = self.rng
        parts = [self.words(8, 150) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            parts[0] = self.tag("b", self.words(1, 8), True)
        return rng.choice(["<br><br>", "<br>", " ", "\n"]).join(parts)

    def framed(self, inside: str) -> str:
        """An article with a header and a footer of its own."""
        rng = self.rng
        title = f"<{(h := rng.choice(['h1', 'h2']))}>{self.words(1, 9)}</{h}>"
        byline = rng.choice(["", f"<p>{self.words(1, 6)}</p>", f"<span>{self.words(1, 5)}</span>", self.links()])
        foot = rng.choice([f"<p>{self.words(1, 15)}</p>", self.links(), self.words(1, 10)])
        head = self.tag("header", title + byline, False, rng.choice(["", "", "entry-header"]))
        return head + inside + (self.tag("footer", foot, False) if rng.random() < 0.7 else "")

    def article(self) -> str:
        rng = self.rng
        if rng.random() < 0.12:
            names = rng.choice(["", "", self.some("content text main body story")])
            return self.tag(rng.choice(["div", "div", "section", "article", "main", "td"]), self.bare(), True, names)
        parts = [self.tag(rng.choice(["h1", "h1", "h2"]), self.words(1, 12), True)] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9) if rng.random() < 0.94 else rng.randint(20, 200)):
            roll = rng.random()
            if roll < 0.6:
                parts.append(self.tag("p", self.prose(True), True))
            elif roll < 0.68:
                parts.append(self.tag(rng.choice(["h2", "h3", "h4"]), self.words(1, 8), True))
            elif roll < 0.76:
                items = "".join(self.tag("li", self.prose(True), True) for _ in range(rng.randint(1, 5)))
                parts.append(self.tag(rng.choice(["ul", "ol"]), items, True))
            elif roll < 0.8:
                parts.append(self.tag("blockquote", rng.choice([self.words(3, 40), self.paragraphs(True, 1, 2)]), True))
            elif roll < 0.83:
                parts.append(self.tag("pre", self.words(3, 30), True))
            elif roll < 0.86:
                cells = "".join(self.tag("td", self.words(1, 6), True) for _ in range(3))
                parts.append(self.tag("table", self.tag("tr", cells, True), True))
            elif roll < 0.9:
                parts.append(self.tag(rng.choice(["div", "section"]), self.paragraphs(True, 1, 3), True, rng.choice(["", "", self.some("text section lead intro")])))
            elif roll < 0.92:
                parts.append(f"<p data-content><b data-content>{self.words(3, 60)}<br><p data-content>{self.words(1, 60)}</p>")
            else:
                parts.append(self.junk())
        inside = "".join(parts)
        roll = rng.random()
        if rng.random() < 0.2:
            paragraphs = self.paragraphs(True, 2, rng.choice([8, 8, 60]))
            return self.tag(rng.choice(["article", "article", "main"]), self.framed(paragraphs), True)
        if roll < 0.45:
            return self.tag("article", inside, True, rng.choice(["", "", self.some("post entry story article hentry")]))
        if roll < 0.6:
            return self.tag("main", inside, True, rng.choice(["", self.some("content main")]))
        if roll < 0.7:
            return self.tag("main", self.tag("article", inside, True), True)
        if roll < 0.88:
            return self.tag(rng.choice(["div", "div", "section", "td"]), inside, True, self.some("content article post entry story body text main article-body post-content entry-content story-body articleBody"))
        return inside

    def page(self) -> str:
        rng = self.rng
        before, after = [], []
        if rng.random() < 0.5:
            before.append(self.tag("header", rng.choice([self.words(1, 8), f"<h1>{self.words(1, 3)}</h1>", self.links()]), False, rng.choice(["", "header"])))
        elif rng.random() < 0.3:
            before.append(self.tag("div", rng.choice([self.words(1, 8), f"<p>{self.words(1, 9)}</p>"]), False, self.some("header masthead logo top banner branding")))
        if rng.random() < 0.8:
            before.append(self.tag(rng.choice(["nav", "nav", "div", "ul"]), self.links(), False, self.some("nav menu navigation navbar topnav")) if rng.random() < 0.5 else self.tag("nav", self.links(), False))
        for _ in range(rng.choice([0, 1, 1, 2])):
            rng.choice([before, after]).append(self.junk())
        if rng.random() < 0.3:
            rng.choice([before, after]).append(self.tag("div", self.paragraphs(False, 1, 3) + self.links(), False, self.some("sidebar side rail widgets secondary column")))
        if rng.random() < 0.35:
            after.append(self.comments())
        if rng.random() < 0.7:
            after.append(self.tag("footer", rng.choice([self.words(2, 25), self.paragraphs(False, 1, 2), self.links()]), False))
        elif rng.random() < 0.5:
            after.append(self.tag("div", rng.choice([self.words(2, 25), self.paragraphs(False, 1, 2)]), False, self.some("footer copyright bottom legal colophon")))
        roll = rng.random()
        if roll < 0.06:
            # the body itself holds the text, between the rest of the page
            marked = "".join(before) + self.bare() + "".join(after)
            return f"<html><head><title>x</title></head><body data-content>{marked}</body></html>"
        if roll < 0.14:
            # a layout table: a cell of links beside the cell of the article
            cells = [
                self.tag("td", self.links() + rng.choice(["", f"<p>{self.words(1, 6)}</p>"]), False),
                self.tag("td", rng.choice([self.bare(), self.paragraphs(True, 1, 6)]), True),
            ]
            rng.shuffle(cells)
            table = self.tag("table", self.tag("tr", "".join(cells), False), False)
            return f"<html><head><title>x</title></head><body>{''.join(before)}{table}{''.join(after)}</body></html>"
        inside = "".join(before) + self.article() + "".join(after)
        if rng.random() < 0.3:
            inside = self.tag("div", inside, False, rng.choice(["", "wrapper", "container", "page", "site", "layout"]))
        return f"<html><head><title>x</title></head><body>{inside}</body></html>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """The model of the labelled pages."""
    return train([parse(p) for p in labelled_pages(n, seed)])


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(htmls), 256):
            out += extract([parse(h) for h in htmls.iloc[at : at + 256]], shared.value)
        return pd.Series(out, dtype=object)

    texts = pages.select("page_id", "url", text_of("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
