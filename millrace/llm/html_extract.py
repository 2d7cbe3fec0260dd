"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element is described by its tag, attribute tokens, depth, siblings, and by its subtree's text, links,
punctuation and paragraphs. Boosted trees give every element a probability of being content. Decoding picks the
best consistent assignment by dynamic programming over the tree: an element is outside (content may lie below it),
content, or dropped; below content there is content or dropped, below dropped only dropped. So no element is kept
inside one that was dropped from the content.

Training: generated pages of many layouts (``GENERATED``), and a bounded sample of the given pages
(``SAMPLE_PAGES``) in which an article element marks the content. Extraction is one narrow pass over whole pages.

Parsing takes time in proportion to the page, however broken it is. Tags end where HTML's attribute states end them, so a
stray quote in a name or in a value without quotes swallows nothing; a tag or comment that never ends swallows the rest, as in
browsers. What an opening tag closes (paragraphs, list items, table cells) is known from pointers that each element has,
what a closing tag closes from a count of open elements; neither walks over more elements than it closes.

Cases: null and empty html give empty text; text and elements outside of any body stand in an implied body, which is judged like
any other element, so a fragment or a page without markup keeps its text; very deep trees are walked without recursion.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import slices, small_batches, tidy

SAMPLE_PAGES, GENERATED, SEED = 200, 600, 5
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.3

#: Fixed values of HTML: elements without content, whose content is no text, that break lines, and what ends a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math iframe object head select textarea title button canvas audio video".split())
NEVER = HIDDEN | {"nav"}
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: What closes a paragraph, list item, term, row, cell or option, and what it stops at.
REACH = [({"p"}, {"button", "table", "td", "th"}), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"})]
NEAR, NOTHING = frozenset().union(*[x | y for x, y in REACH]), (None,) * len(REACH)
CLOSED_BY = {"li": (1,), "dt": (2,), "dd": (2,), "tr": (3, 4), "td": (4,), "th": (4,), "option": (5,)}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li a b i em strong span nav header footer aside form table tr td blockquote pre figure figcaption body html dl dd dt label input button".split()
WORDS = "content article post entry main story body text page wrapper container nav menu header footer sidebar side aside widget ad ads advert banner promo sponsor cookie notice consent alert popup modal comment comments reply share social related recommended recent breadcrumb breadcrumbs search form login newsletter subscribe tags meta author byline copyright legal toolbar top bottom links list logo skip".split()

LONG_WORDS = [w for w in WORDS if len(w) >= 3]
#: What may stand in a head, and at the top without opening a body.
HEADED = frozenset("base link meta noscript script style template title".split())

WELL_FORMED = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*+)((?:\s++[a-zA-Z_:][\w:.-]*+(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'=<>`/]++))?)*+)\s*+(/?)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
NAME = re.compile(r"[\s/]*+(?:[^\s/>][^\s/>=]*+(\s*+=\s*+)?)?")
UNQUOTED = re.compile(r"[^\s>]*+")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 14)
def parts(name: str) -> frozenset:
    """Words of an attribute value; of a compound also the known word that it starts or ends with (``navbar``, ``sitefooter``)."""
    words = PART.findall(name.lower())
    return frozenset(words) | {w for w in LONG_WORDS for x in words if x != w and (x.startswith(w) or x.endswith(w))}


class Node:
    __slots__ = ("tag", "parent", "kids", "items", "tokens", "depth", "order", "own", "size", "linked", "marks", "paras", "below", "rank", "near")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        #: items: texts and nodes in order; kids: nodes only.
        self.kids: list[Node] = []
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0
        #: Nearest open element of each kind that an opening tag may close: paragraph, list item, term, row, cell, option.
        self.near: tuple = parent.near if parent else NOTHING
        if tag in NEAR:
            self.near = tuple(self if tag in ends else None if tag in stops else x for x, (ends, stops) in zip(self.near, REACH))


def tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes start at ``at`` ends (after its ``>``), by HTML's attribute states; -1 if it never does."""
    while True:
        m = NAME.match(page, at)
        named, at = m.end() > m.start(), m.end()
        c = page[at : at + 1]
        if m[1] and c in ("'", '"') and c:
            at = page.find(c, at + 1) + 1
            if not at:
                return -1
        elif m[1] and c != ">":
            at = UNQUOTED.match(page, at).end()
        elif c == ">":
            return at + 1
        elif not c or not named:
            return -1


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash of an end tag, name, attributes) of each tag; what follows the last one comes with an empty name."""
    at, text, end = 0, [], len(page)
    while at < end:
        m = page.find("<", at)
        text.append(page[at : m if m >= 0 else end])
        if m < 0:
            break
        if t := WELL_FORMED.match(page, m):
            at, slash, name, attributes = t.end(), t[1], t[2].lower(), t[3] + t[4]
        elif t := TAG_NAME.match(page, m):
            at, slash, name = tag_end(page, t.end()), t[1], t[2].lower()
            if at < 0:
                break
            attributes = page[t.end() : at - 1]
        else:
            if page.startswith("<!--", m):
                short = next((x for x in (">", "->") if page.startswith(x, m + 4)), None)
                close = m + 4 + len(short) if short else max(page.find("-->", m + 4) + 3, 2)
            elif page[m + 1 : m + 2] in ("!", "?", "/") and m + 1 < end:
                close = max(page.find(">", m + 1) + 1, 0) or 2
            else:  # an ordinary sign
                text.append("<")
                at = m + 1
                continue
            if close == 2:
                break
            at = close
            continue
        yield "".join(text), slash, name, attributes
        text = []
        if not slash and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = tag_end(page, close.end()) if close else -1
            if at < 0:
                return
    yield "".join(text), "", "", ""


def parse(page: str | None) -> list[Node]:
    """The elements of a page in document order; the first is a root above all."""
    root = Node("#root", None, frozenset())
    nodes, here, body = [root], root, None
    open_now: dict[str, int] = {}

    def add(tag: str, parent: Node, tokens: frozenset = frozenset()) -> Node:
        node = Node(tag, parent, tokens)
        parent.kids.append(node)
        parent.items.append(node)
        nodes.append(node)
        return node

    def close(to: Node) -> None:
        """Closes ``to`` and all that is open in it."""
        nonlocal here
        while True:
            open_now[here.tag] -= 1
            here, done = here.parent, here is to
            if done:
                return

    def in_body() -> None:
        nonlocal here, body
        if here.tag == "head":
            close(here)
        if here.tag in ("#root", "html"):
            if body is None:
                body = add("body", here)
                open_now["body"] = open_now.get("body", 0) + 1
            here = body

    for text, slash, tag, attributes in markup(page or ""):
        if text:
            if here.tag in ("#root", "html", "head") and not text.isspace():
                in_body()
            if here.tag not in HIDDEN and here.tag not in ("#root", "html"):
                here.items.append(entities.unescape(text))
        if not tag:
            continue
        if slash:
            if tag not in ("body", "html") and open_now.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                close(up)
            continue
        tokens = frozenset().union(*[parts(a or b or c) for _, a, b, c in ATTRIBUTE.findall(attributes)]) if attributes else frozenset()
        if tag in ("html", "head", "body"):
            if tag == "html" and here is root and len(nodes) == 1 or tag == "head" and here.tag in ("#root", "html") and body is None:
                here = add(tag, here, tokens)
                open_now[tag] = 1
            elif tag == "body":
                if here.tag == "head":
                    close(here)
                if body is None and here.tag in ("#root", "html"):
                    here = body = add(tag, here, tokens)
                    open_now[tag] = 1
            continue
        if tag not in HEADED and here.tag in ("#root", "html", "head"):
            in_body()
        if tag in ENDS_P and here.near[0] is not None:
            close(here.near[0])
        for k in CLOSED_BY.get(tag, ()):
            if here.near[k] is not None:
                close(here.near[k])
                break
        node = add(tag, here, tokens)
        if tag not in RAW and tag not in VOID and (tag in BLOCK or not attributes.endswith("/")):
            here = node
            open_now[tag] = open_now.get(tag, 0) + 1
    measure(nodes)
    return nodes


def measure(nodes: list[Node]) -> None:
    """Sums over subtrees, from the last node back to the first."""
    for k, n in enumerate(nodes):
        own = [x for x in n.items if type(x) is str]
        n.order, n.own = k, sum(len(x.strip()) for x in own)
        n.size, n.marks, n.below = n.own, sum(x.count(",") + x.count(".") for x in own), 0
        n.linked = n.own if n.tag == "a" else 0
        n.paras = int(n.tag == "p")
        for r, kid in enumerate(n.kids):
            kid.rank = r
    nodes[0].rank = 0
    for n in reversed(nodes[1:]):
        p = n.parent
        p.size += n.size
        p.marks += n.marks
        p.below += n.below + 1
        p.paras += n.paras
        p.linked += n.size if p.tag == "a" else n.linked


NAMES = ["depth", "size", "share", "density", "link share", "marks", "paras", "kids", "siblings", "rank", "own", "position", "parent size", "up words good", "up words bad"]
N_FEATURES = len(NAMES) + len(TAGS) + len(WORDS) + 6
GOOD, BAD = frozenset(WORDS[:9]), frozenset(WORDS[11:])
TAG_AT, WORD_AT = {t: len(NAMES) + i for i, t in enumerate(TAGS)}, {w: len(NAMES) + len(TAGS) + i for i, w in enumerate(WORDS)}
UP = {t: N_FEATURES - 6 + i for i, t in enumerate(("article", "main", "nav", "footer", "aside", "form"))}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element: numbers, tag, attribute tokens, and which marked elements lie above."""
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    total, count = max(1, nodes[0].size), len(nodes)
    above: list[tuple[frozenset, int, int]] = [(frozenset(), 0, 0)] * count
    numbers = []
    for k, n in enumerate(nodes):
        p = n.parent
        up, good, bad = above[p.order] if p else (frozenset(), 0, 0)
        size = n.size
        numbers.append((n.depth, size, size / total, size / (n.below + 1), n.linked / size if size else 0, n.marks / size if size else 0, n.paras, len(n.kids), len(p.kids) if p else 0, n.rank / len(p.kids) if p else 0, n.own, k / count, p.size if p else 0, good, bad))
        if n.tag in TAG_AT:
            x[k, TAG_AT[n.tag]] = 1
        for w in n.tokens:
            if w in WORD_AT:
                x[k, WORD_AT[w]] = 1
        for t in up:
            x[k, UP[t]] = 1
        if n.tag in UP:
            up = up | {n.tag}
        above[k] = (up, good + len(n.tokens & GOOD), bad + len(n.tokens & BAD))
    x[:, : len(NAMES)] = numbers
    return x


@dataclass
class Boosted:
    """Boosted trees on binned features. Trees are complete: node i has children 2i+1 and 2i+2."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") if len(e) else np.zeros(len(x), np.int64) for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, line = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[line, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Newton boosting of the logistic loss with histograms."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        edges.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if len(values) > BINS else values[:-1])
    model = Boosted(edges, np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH)), 0.0)
    used = np.array([f for f, e in enumerate(edges) if len(e)])
    b = model.binned(x)[:, used].astype(np.int64)
    mean = float(np.average(y, weights=weight))
    model.base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), model.base)
    features_, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, at = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            shape = (len(used), width, BINS + 1)
            hg, hh = np.zeros(shape), np.zeros(shape)
            for k in range(len(used)):
                key = local * (BINS + 1) + b[:, k]
                hg[k] = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1)
                hh[k] = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1)
            lg, lh = hg.cumsum(2), hh.cumsum(2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            gain[(lh < 1e-3) | (th - lh < 1e-3)] = 0
            for i in range(width):
                k, c = np.unravel_index(gain[:, i].argmax(), gain[:, i].shape)
                if gain[k, i, c] > 1e-6:
                    feature[first + i], cut[first + i] = used[k], c
            column = np.searchsorted(used, feature[at])
            at = 2 * at + 1 + (b[np.arange(len(y)), np.minimum(column, len(used) - 1)] > cut[at])
        which = at - (2**DEPTH - 1)
        value = RATE * np.bincount(which, g, 2**DEPTH) / (np.bincount(which, h, 2**DEPTH) + 1)
        score += value[which]
        features_.append(feature)
        cuts.append(cut)
        leaves.append(value)
    model.feature, model.cut, model.leaf = np.array(features_), np.array(cuts), np.array(leaves)
    return model


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which elements are content, by the best consistent assignment; elements count by their own text."""
    n = len(nodes)
    odds = np.clip(log_odds, -8, 8) * np.array([1 + min(x.own, 400) / 40 for x in nodes])
    if n == 2 and nodes[1].tag == "body":  # text without markup
        return np.array([False, True])
    best = [[0.0, float(o), 0.0] for o in odds]  # outside, content, dropped: gain over being no content
    best[0][1] = float("-inf")
    for k in range(n - 1, 0, -1):
        if nodes[k].tag in NEVER:
            best[k] = [0.0, float("-inf"), 0.0]
        out, content, _ = best[k]
        up = best[nodes[k].parent.order]
        up[0] += max(out, content, 0.0)
        up[1] += max(content, 0.0)
    state = np.zeros(n, np.int8)  # 0 outside, 1 content, 2 dropped
    for k in range(n):
        above = state[nodes[k].parent.order] if k else 0
        out, content, _ = best[k]
        state[k] = 2 if nodes[k].tag in NEVER else (1 if content > max(out, 0.0) else 0) if above == 0 else (1 if content > 0 else 2) if above == 1 else 2
    return state == 1


def text_of(nodes: list[Node], content: np.ndarray) -> str:
    """Content in page order: blocks trimmed, white space collapsed, joined by one space."""
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(inline).split()):
            blocks.append(s)
        inline.clear()

    stack: list = [iter((nodes[0],))]
    opened: list[Node | None] = [None]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            node = opened.pop()
            if node is not None and node.tag in BLOCK:
                flush()
        elif type(item) is str:
            if content[opened[-1].order]:
                inline.append(item)
        elif item.tag == "br":
            inline.append(" ")
        elif item.tag not in HIDDEN:
            if item.tag in BLOCK:
                flush()
            stack.append(iter(item.items))
            opened.append(item)
    flush()
    return " ".join(blocks)


def _mark(nodes: list[Node]) -> np.ndarray | None:
    """Content of a page in which one article element marks it, else nothing."""
    marks = [n for n in nodes if n.tag == "article"] or [n for n in nodes if n.tag == "main"]
    if len(marks) != 1:
        return None
    y = np.zeros(len(nodes))
    for n in nodes:
        inside = n is marks[0] or (n.parent is not None and y[n.parent.order])
        y[n.order] = inside and n.tag not in ("nav", "aside", "form", "footer", "script", "style") and not n.tokens & {"ad", "ads", "advert", "comments", "comment", "share", "related", "notice", "promo", "newsletter"}
    return y


def generate(rng: random.Random) -> tuple[str, str]:
    """A page of a random layout, and the mark (a class) that its content element and content bear."""
    pool = [("".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9)))) for _ in range(60)]
    scale = rng.choice((1, 1, 1, 1, 0.1))  # few pages are very short
    words = lambda a, b: " ".join(rng.choice(pool) + rng.choice(("", "", "", "", ",", ".")) for _ in range(max(1, int(scale * rng.randint(a, b)))))
    links = lambda n: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))
    named = lambda *names: rng.choice(('class="{}"', 'id="{}"')).format(rng.choice(names) + rng.choice(("", "", "-inner", " box", "-wrap")))
    junk = [
        lambda: f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>",
        lambda: f"<div {named('menu', 'nav', 'breadcrumbs', 'toolbar')}><ul>{links(rng.randint(2, 8))}</ul></div>",
        lambda: f"<div {named('ad', 'ads', 'advert', 'banner', 'promo', 'sponsor')}>{words(3, 25)}</div>",
        lambda: f"<aside{rng.choice(('', ' class=sidebar'))}><h3>{words(1, 4)}</h3><p>{words(5, 40)}</p><ul>{links(3)}</ul></aside>",
        lambda: f"<div {named('sidebar', 'widget', 'related', 'recent', 'recommended')}><h3>{words(1, 3)}</h3><p>{words(5, 30)}</p></div>",
        lambda: f"<div {named('cookie-notice', 'consent', 'notice', 'alert', 'popup')}><p>{words(8, 40)}</p><button>{words(1, 2)}</button></div>",
        lambda: f"<form {named('search', 'login', 'newsletter', 'subscribe')}><label>{words(2, 8)}</label><input type=text><p>{words(3, 12)}</p></form>",
        lambda: f"<div {named('share', 'social', 'tags')}>{links(3)}</div>",
        lambda: f"<div {named('menu', 'nav', 'topbar', rng.choice(pool))}>" + rng.choice(("", " ", "<br>", " | ")).join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rng.randint(2, 6))) + "</div>",
    ]
    late = [
        lambda: f"<section {named('comments', 'comment-list', 'replies comments')}><h3>{words(1, 3)}</h3>" + "".join(f"<div class=\"comment\"><b>{words(1, 2)}</b><p>{words(6, 50)}</p></div>" for _ in range(rng.randint(1, 6))) + "</section>",
        lambda: f"<footer>&copy; {words(2, 20)}</footer>",
        lambda: f"<div {named('footer', 'copyright', 'legal', 'bottom')}><p>{words(5, 40)}</p></div>",
        lambda: f"<div {named('footer', 'bottom', rng.choice(pool))}>&copy; 20{rng.randint(10, 30)} {words(2, 12)}</div>",
    ]
    mark = "zzmark"
    open_, close = rng.choice((("<article class='zzmark'>", "</article>"), ("<main class='zzmark'>", "</main>"), (f"<div class='zzmark {rng.choice(('content', 'post', 'entry', 'article-body', 'story', 'main'))}'>", "</div>"), ("<div class='zzmark'>", "</div>"), ("<section class='zzmark post'>", "</section>")))
    body = [f"<h1>{words(3, 9)}</h1>"] * (rng.random() < 0.8)
    for _ in range(rng.randint(1, 14)):
        r = rng.random()
        if r < 0.7:
            body.append(f"<p>{words(2, 90)}{rng.choice(('', f' <a href=/x>{words(1, 3)}</a> {words(1, 9)}', f' <b>{words(1, 5)}</b>'))}</p>")
        elif r < 0.78:
            body.append(f"<p><b>{words(4, 30)}<br><p>{words(4, 40)}</p>")
        elif r < 0.85:
            body.append(f"<h2>{words(2, 6)}</h2>")
        elif r < 0.9:
            body.append("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif r < 0.93:
            body.append(f"<blockquote>{words(5, 30)}</blockquote>")
        elif r < 0.96:
            body.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            body.append(rng.choice(junk[2:])())
    if rng.random() < 0.05:  # no markup at all
        return f"<body class='zzmark'>{words(20, 120)}", mark
    if rng.random() < 0.25:  # a fragment: text and paragraphs straight in the body
        inner = lambda: rng.choice((words(4, 60), f"{words(4, 40)} <b>{words(1, 4)}</b> {words(2, 30)}", f"{words(4, 40)} <a href=/x>{words(1, 3)}</a> {words(2, 30)}", f"<i>{words(1, 6)}</i> {words(4, 30)}"))
        bare = rng.choice((0, 0.2, 0.5, 1))
        lines = [inner() if rng.random() < bare else f"<p>{inner()}</p>" for _ in range(rng.randint(1, 8))]
        around = [f() for f in rng.sample(junk, rng.choice((0, 0, 1, 2)))]
        return f"<body class='zzmark'>{''.join(around[:1])}{f'<h1>{words(2, 7)}</h1>' * (rng.random() < 0.3)}{rng.choice(('', '<br>', '<br><br>')).join(lines)}{''.join(around[1:])}{''.join(f() for f in late if rng.random() < 0.2)}", mark
    before, after = [f() for f in rng.sample(junk, rng.randint(1, 4))], [f() for f in rng.sample(junk, rng.randint(0, 3))] + [f() for f in late if rng.random() < 0.6]
    wrap = rng.choice((("", ""), ("<div class='wrapper'>", "</div>"), ("<div id='page'><div class='container'>", "</div></div>")))
    head = f"<header><h2>{words(1, 4)}</h2></header>" if rng.random() < 0.4 else ""
    return f"<html><head><title>{words(2, 6)}</title></head><body>{wrap[0]}{head}{''.join(before)}{open_}{''.join(body)}{close}{''.join(after)}{wrap[1]}</body></html>", mark


def train(pages: list[str], seed: int = SEED, generated: int = GENERATED) -> Boosted:
    rng = random.Random(seed)
    xs, ys, ws = [], [], []

    def add(nodes: list[Node], y: np.ndarray) -> None:
        xs.append(features(nodes)[1:])
        ys.append(y[1:])
        ws.append(np.array([0.2 + min(n.own, 200) / 100 for n in nodes[1:]]))

    for _ in range(generated):
        page, mark = generate(rng)
        nodes = parse(page)
        y = np.zeros(len(nodes))
        for n in nodes:
            inside = mark in n.tokens or (n.parent is not None and y[n.parent.order])
            y[n.order] = inside and n.tag not in ("aside", "form", "nav", "header", "footer") and not (n.tag != "p" and n.tokens - {mark} and mark not in n.tokens)
            n.tokens = n.tokens - {"zzmark"}
        add(nodes, y)
    for page in pages:
        nodes = parse(page)
        y = _mark(nodes)
        if y is not None:
            add(nodes, y)
    return fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract(model: Boosted, pages: list[str | None]) -> list[str]:
    """Main texts of pages; elements of several pages are scored in one step."""
    out = []
    for k in range(0, len(pages), 64):
        trees = [parse(p) for p in pages[k : k + 64]]
        odds = model.log_odds(np.concatenate([features(t) for t in trees]))
        at = 0
        for t in trees:
            out.append(text_of(t, decode(t, odds[at : at + len(t)])))
            at += len(t)
    return out


def train_on(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Boosted:
    """Trains on generated pages and on at most ``rows`` pages, chosen by a hash of their html."""
    usable = pages.select("html", F.xxhash64("html").alias("h")).filter("html IS NOT NULL")
    lowest = usable.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    sample = usable.filter(F.col("h") <= lowest).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if lowest is not None else []
    return train([r.html for r in sample])


def extract_pages(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2):
                texts = extract(model, b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return small_batches(rows).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
