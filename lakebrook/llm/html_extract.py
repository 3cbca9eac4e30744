"""Main-text extraction from HTML (operator 1) by a tree-structured graphical model.

A page is parsed into its block elements. Each is a binary variable (part of the main text or not) with a score from
its own features (tag, words of class, id and role, text and link statistics of its subtree); each parent-child edge has
a 2 x 2 potential by the kind of child. Sum-product message passing, once up and once down the tree, gives exact
marginals, for all pages of a batch at once. Weights and potentials maximise the likelihood of labelled pages; these are
made by labelled_pages(), as no table has page labels: articles in many markups, among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.

Text of blocks with a marginal of MARGINAL or more is returned whole: character references decoded, white space inside a
block turned into one space, trimmed, blocks in page order joined by a line break. A <br> is white space.

A page is read once, from left to right, in time linear in its length; pages are scored in batches of bounded size.

Defined cases: null html is an empty page; pages without main text give an empty string. Broken markup never fails: a "<"
that starts no tag is text, open elements end with the page, unknown end tags are passed over, an open comment lasts to
the end. Quotes that a page's tags can't be read with are plain characters from there on. Elements without text of the
page end with their parent; where one has no end tag at all, scripts and styles as well, it ends at the next block's tag.
Elements nested deeper than DEEPEST count as children of the one there. Repeated rows are all kept; an empty table gives
no rows; extra columns are passed over.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning, table

MARGINAL = 0.5
TRAINING_PAGES, EPOCHS = 240, 220
#: Levels of a tree, as in browsers; characters of the pages that are scored at once (or one longer page).
DEEPEST, BATCH_CHARS = 512, 1 << 21
#: Elements that are variables; all others are inline, and their text belongs to the block around them.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th "
    "figure figcaption header footer nav aside form fieldset address details summary dialog menu hgroup center label search".split()
)
TAGS = sorted(BLOCKS)
#: Elements whose content is no text of the page: of raw text up to their end tag, and of elements.
RAW = frozenset("script style iframe textarea title".split())
HIDDEN = frozenset("noscript template select button svg object audio video canvas".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
ENDS_P = BLOCKS - {"label"}
#: An open element of the first kind ends where one of the second starts.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|data-y)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(frozen=True, slots=True)
class Tag:
    start: int
    end: int
    closing: bool
    name: str  # "" for comments, declarations and raw text with its tags
    attrs: str
    shut: bool = False  # ends with "/>"


def tags(source: str) -> Iterator[Tag]:
    """The tags of a page in order, and what else is no text; every character is passed a bounded number of times."""
    at, last = 0, source.rfind(">")
    quoting, absent, endless = True, set(), set()
    while (at := source.find("<", at)) >= 0:
        start = at
        if source.startswith("<!--", start):
            whole = next((x for x in ("<!-->", "<!--->") if source.startswith(x, start)), None)
            close = source.find("-->", start + 4)
            at = start + len(whole) if whole else close + 3 if close >= 0 else len(source)
            yield Tag(start, at, False, "", "")
            continue
        if last < start:
            if source.startswith(("</", "<!", "<?"), start) and not _NAME.match(source, start):
                at = len(source)
                yield Tag(start, at, False, "", "")
                continue
            return
        named = _NAME.match(source, start)
        if named is None:
            at = start + 1
            if source.startswith(("</", "<!", "<?"), start):
                at = source.find(">", start) + 1
                yield Tag(start, at, False, "", "")
            continue
        end, seek = -1, named.end()
        while quoting:
            stop = _STOP.search(source, seek)
            if stop is None:
                quoting = False  # no tag that starts here ends with its quotes; nor is it tried again
                break
            seek, mark = stop.end(), stop.group()
            if mark == ">":
                end = seek
                break
            if mark not in absent:
                other = source.find(mark, seek)
                if other < 0:
                    absent.add(mark)
                else:
                    seek = other + 1
        if end < 0:
            end = source.find(">", named.end()) + 1
        closing, name = source[start + 1] == "/", named[1].lower()
        at = end
        if name in RAW and not closing and name not in endless:
            until = _RAW_ENDS[name].search(source, at)
            if until is None:
                endless.add(name)
            else:
                at = source.find(">", until.end()) + 1 or len(source)
                yield Tag(start, at, False, "", "")
                continue
        yield Tag(start, end, closing, name, source[named.end() : end - 1], source[end - 2] == "/")


def _unclosed(found: list[Tag]) -> set[int]:
    """Where start tags are, of elements without text of the page, that no end tag belongs to."""
    opened: dict[str, list[int]] = {}
    for tag in found:
        if tag.name in HIDDEN or tag.name in RAW:
            of = opened.setdefault(tag.name, [])
            if not tag.closing:
                if not (tag.name == "svg" and tag.shut):
                    of.append(tag.start)
            elif of:
                of.pop()
    return {at for of in opened.values() for at in of}


class Page:
    """Block elements in page order and the runs of text between them."""

    __slots__ = ("parent", "tag", "marks", "label", "owner", "texts", "linked")

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.marks: list[tuple[str, ...]] = [()]
        self.label: list[int] = [1]
        self.owner: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, names, count = [0], ["html"], Counter()
        run: list[str] = []
        links = in_link = 0
        # open elements from the hidden one inwards; whether that one lacks an end tag and ends at any block's tag
        hidden: list[str] = []
        inside: Counter = Counter()
        loose = False
        found = list(tags(source))
        unclosed = _unclosed(found)

        def flush():
            nonlocal links
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.owner.append(stack[min(len(stack), DEEPEST) - 1])
                    self.texts.append(text)
                    self.linked.append(min(links, len(text)))
                run.clear()
            links = 0

        def say(text: str):
            nonlocal links
            if text and not hidden:
                text = references.unescape(text) if "&" in text else text
                run.append(text)
                if in_link:
                    links += len(text.strip())

        def leave():
            count[names.pop()] -= 1
            stack.pop()

        at = 0
        for tag in found:
            say(source[at : tag.start])
            at = tag.end
            name, closing = tag.name, tag.closing
            if not name:
                if not source.startswith("<!", tag.start):
                    run.append(" ")
                continue
            if name == "head":
                continue
            if (name in HIDDEN or name in RAW) and not closing:
                run.append(" ")
                # "/>" ends svg only; others go on
                if not (name == "svg" and tag.shut):
                    lacks = tag.start in unclosed
                    if not hidden or loose:
                        hidden, inside, loose = [name], Counter([name]), lacks
                    elif not lacks:
                        hidden.append(name)
                        inside[name] += 1
                continue
            if hidden:
                if closing and inside[name]:
                    while True:
                        inside[last := hidden.pop()] -= 1
                        if last == name:
                            break
                    continue
                if name in BLOCKS and (loose or closing and count[name]):
                    hidden, inside = [], Counter()
                else:
                    if name in BLOCKS and not closing:
                        hidden.append(name)
                        inside[name] += 1
                    continue
            elif name in HIDDEN or name in RAW:
                continue
            if name == "br":
                run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name == "a":
                in_link = 0 if closing else 1
            if name not in BLOCKS:
                continue
            flush()
            if closing:
                if count[name]:
                    while names[-1] != name:
                        leave()
                    leave()
                    in_link = 0
                continue
            if name == "html":
                continue
            if names[-1] == "p" and name in ENDS_P:
                leave()
            else:
                while names[-1] in ENDED_BY and name in ENDED_BY[names[-1]]:
                    leave()
            marks, label = [], 0
            if tag.attrs:
                for key, *values in _NAMED.findall(tag.attrs):
                    value = "".join(values)
                    if key.lower() == "data-y":
                        label = int(value == "1")
                    else:
                        marks += [w.lower() for w in _WORD.findall(value)]
            self.parent.append(stack[min(len(stack), DEEPEST) - 1])
            self.tag.append(name)
            self.marks.append(tuple(marks))
            self.label.append(label)
            stack.append(len(self.tag) - 1)
            names.append(name)
            count[name] += 1
        say(source[at:])
        flush()


@dataclass(frozen=True)
class Forest:
    """The trees of many pages, as arrays over all their nodes. A node's features are statistics, its tag and its words."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes by depth, roots first
    shape: np.ndarray  # nodes x (1 + STATISTICS)
    tag: np.ndarray
    marked: tuple[np.ndarray, np.ndarray]  # (node, word), each pair once
    words: int
    label: np.ndarray
    first: np.ndarray  # each page's first node

    def scores(self, weights: np.ndarray) -> np.ndarray:
        own, tag, word = np.split(weights, [self.shape.shape[1], self.shape.shape[1] + len(TAGS)])
        return self.shape @ own + tag[self.tag] + np.bincount(self.marked[0], word[self.marked[1]], len(self.tag))

    def slopes(self, residual: np.ndarray) -> np.ndarray:
        """The derivative of residual * scores by the weights."""
        return np.concatenate([residual @ self.shape, np.bincount(self.tag, residual, len(TAGS)), np.bincount(self.marked[1], residual[self.marked[0]], self.words)])


STATISTICS = 10


def forest(pages: list[Page], words: dict[str, int]) -> Forest:
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    parent = np.full(n, -1)
    own = np.zeros((n, 4))  # characters, linked characters, words, marks that end sentences
    depth = np.zeros(n, np.int64)
    numbers = {t: i for i, t in enumerate(TAGS)}
    shape = np.zeros((n, 1 + STATISTICS))
    tag, kind, label = (np.zeros(n, np.int64) for _ in range(3))
    marked: list[tuple[int, int]] = []
    for p, base in zip(pages, first.tolist()):
        for i, (up, name, marks) in enumerate(zip(p.parent, p.tag, p.marks)):
            if up >= 0:
                parent[base + i] = base + up
                depth[base + i] = depth[base + up] + 1
            tag[base + i] = numbers[name]
            kind[base + i] = 0 if name in TEXTUAL else 1 if name in ("div", "section", "article", "main") else 2
            marked += [(base + i, words[w]) for w in {*marks} if w in words]
        label[base : base + len(p.tag)] = p.label
        for o, t, k in zip(p.owner, p.texts, p.linked):
            own[base + o] += (len(t), k, t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?"))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    whole = own.copy()
    for level in reversed(levels[1:]):
        np.add.at(whole, parent[level], whole[level])
    chars, links, count, ends = np.maximum(whole, 0).T
    shape[:, 0] = 1
    shape[:, 1:9] = np.stack(
        [
            np.log1p(chars) / 8, links / np.maximum(chars, 1), np.minimum(1, ends / np.maximum(count, 1)), count < 4, count >= 20, chars == 0,
            np.log1p(own[:, 0]) / 8, own[:, 1] / np.maximum(own[:, 0], 1),
        ],
        axis=1,
    )
    page_chars = np.repeat(chars[first[:-1]], np.diff(first)) if n else chars
    shape[:, 9] = chars / np.maximum(page_chars, 1)
    shape[:, 10] = (links / np.maximum(chars, 1) > 0.6) & (chars > 0)
    pairs = np.array(marked, np.int64).reshape(-1, 2)
    return Forest(parent, kind, levels, shape, tag, (pairs[:, 0], pairs[:, 1]), len(words), label, first)


def marginals(f: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each node, and for each node the joint distribution of its parent's label and its own."""
    n = len(unary)
    score = np.stack([np.zeros(n), unary], axis=1)
    up = np.zeros((n, 2))
    belief = score.copy()  # with all messages from below
    for level in reversed(f.levels[1:]):
        up[level] = np.logaddexp(*np.moveaxis(edge[f.kind[level]] + belief[level][:, None, :], 2, 0))
        np.add.at(belief, f.parent[level], up[level])
    below = belief.copy()
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - up[level]
        both = edge[f.kind[level]] + rest[:, :, None] + below[level][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        np.exp(both, out=both)
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        belief[level] = below[level] + np.logaddexp(*np.moveaxis(edge[f.kind[level]] + rest[:, :, None], 1, 0))
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        f = forest(pages, self.words)
        p, _ = marginals(f, f.scores(self.weights), self.edge)
        return [p[a:b] for a, b in zip(f.first[:-1], f.first[1:])]


def train(pages: list[Page], ridge: float = 0.004) -> Model:
    """Maximum likelihood by gradient ascent (Adam) on weights and edge potentials, with a ridge."""
    words = {w: i for i, w in enumerate(sorted({w for p in pages for m in p.marks for w in m}))}
    f = forest(pages, words)
    theta = np.zeros(f.shape.shape[1] + len(TAGS) + len(words) + 12)
    y = f.label.astype(float)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (f.kind[child], f.label[f.parent[child]], f.label[child]), 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        p, joint = marginals(f, f.scores(theta[:-12]), theta[-12:].reshape(3, 2, 2))
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        slope = np.concatenate([f.slopes(y - p), (seen - expected).ravel()]) / len(pages) - ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(words, theta[:-12], theta[-12:].reshape(3, 2, 2))


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 1) -> list[str]:
    """Pages whose block elements carry data-y: 1 for the main text and what holds it, 0 for the rest."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p

    def some(lo, hi):
        return " ".join("".join(pick("ka", "lo", "mi", "ren", "tu", "sha", "vel", "on", "é", "ü") for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi))))

    def sentence(lo=6, hi=22):
        return (some(lo, hi) + pick(".", ".", "!", "?")).capitalize()

    def el(tag, body, y, marks=""):
        return f'<{tag}{" " + marks if marks else ""} data-y="{y}">{body}</{tag}>'

    def marks(*names):
        return pick(f'class="{pick(*names)}"', f'id="{pick(*names)}"', f'class="{pick(*names)} {pick("box", "wrap", "block", "row", "col", "inner")}"')

    def links(n, y=0, tag="ul", extra=""):
        return el(tag, "".join(el("li", f'<a href="/{some(1, 2)}">{some(1, 4)}</a>', y) for _ in range(n)), y, extra)

    plain = False  # whether the page at hand has prose without marks

    def paragraph():
        body = " ".join(sentence() for _ in range(int(rng.integers(1, 6)))) if chance(0.85) else some(1, 6) + pick("", ".")
        if chance(0.6 if plain else 0.05):
            body = " ".join(some(1, 2) for _ in range(2)) * int(rng.integers(2, 30)) + pick("", ".")
        if chance(0.15):
            body = f"<b>{body}</b>"
        if chance(0.15):
            body += f' <a href="/x">{some(1, 4)}</a> {some(1, 5)}.'
        return el("p", body, 1, marks("lead", "intro", "text", "para") if chance(0.05) else "")

    def menu():
        m = pick("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "tabs", "pagination", "pager")
        return el("nav", links(int(rng.integers(2, 9))), 0, marks(m) if chance(0.4) else "") if chance(0.6) else el("div", links(int(rng.integers(2, 9))), 0, marks(m))

    def aside():
        m = pick("sidebar", "side", "related", "widget", "recommended", "trending", "popular", "promo", "toc", "rail")
        body = (el(pick("h2", "h3"), some(1, 4), 0) if chance(0.6) else "") + pick(links(4), el("p", sentence(3, 12), 0), el("p", sentence() + " " + sentence(), 0) + links(2))
        return el("aside", body, 0, marks(m) if chance(0.5) else "") if chance(0.5) else el("div", body, 0, marks(m))

    def advert():
        m = pick("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner", "promo", "adsense")
        body = pick(some(3, 12) + ".", el("p", sentence(), 0), sentence() + f' <a href="/b">{some(1, 3)}</a>', el("p", sentence(), 0) + el("p", sentence(), 0))
        return el(pick("div", "div", "aside", "section"), body, 0, marks(m))

    def notice():
        m = pick("cookie", "cookies", "consent", "notice", "alert", "banner", "gdpr", "popup", "modal", "disclaimer", "subscribe", "newsletter", "paywall", "signup")
        return el(pick("div", "div", "section", "dialog"), pick(el("p", sentence() + " " + sentence(), 0), sentence()) + pick("", "<button>Ok</button>"), 0, pick(marks(m), 'role="alert"', 'role="dialog"'))

    def form():
        body = "".join(el("label", some(1, 3), 0) + "<input>" for _ in range(int(rng.integers(1, 4)))) + pick("", el("p", sentence(), 0)) + "<button>Go</button>"
        return el("form", body, 0, marks("search", "login", "contact", "form", "subscribe") if chance(0.4) else "")

    def comments():
        one = lambda: el(kind := pick("div", "li", "article", "section"), (el("p", some(1, 3), 0, 'class="author"') if chance(0.5) else "") + el("p", " ".join(sentence() for _ in range(int(rng.integers(1, 4)))), 0), 0, marks("comment", "reply", "comment-body") if kind == "article" or chance(0.7) else "")
        body = (el(pick("h2", "h3"), some(1, 3), 0) if chance(0.6) else "") + "".join(one() for _ in range(int(rng.integers(1, 6))))
        m = marks("comments", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments", "respond")
        return el(pick("section", "div", "div", "ol", "ul", "aside"), body + (form() if chance(0.3) else ""), 0, m)

    def header():
        body = pick(el("div", some(1, 4), 0, marks("logo", "brand", "site-title")), el("p", some(2, 7), 0), el("h1", some(1, 4), 0), el("h2", some(1, 4), 0)) + (menu() if chance(0.5) else "") + (form() if chance(0.2) else "")
        return el("header", body, 0, marks("header", "site-header", "masthead", "top") if chance(0.4) else "") if chance(0.7) else el("div", body, 0, marks("header", "masthead", "site-header", "topbar"))

    def footer():
        body = pick("&copy; " + some(1, 3) + " &middot; " + sentence(), el("p", "&copy; " + sentence(), 0), el("p", sentence(), 0) + links(3), links(5), el("div", sentence(), 0))
        return el("footer", body, 0, marks("footer", "site-footer", "copyright") if chance(0.3) else "") if chance(0.75) else el("div", body, 0, marks("footer", "copyright", "bottom", "legal", "colophon"))

    def extras():
        return pick(
            el("div", "".join(f'<a href="/s">{some(1, 2)}</a> ' for _ in range(3)), 0, marks("share", "social", "sharing", "tags", "follow")),
            el("div", el("p", some(2, 6), 0), 0, marks("author", "byline", "meta", "author-bio", "credits")), advert(), aside(), notice(), form(),
        )

    def article():
        body = []
        if chance(0.85):
            body.append(el(pick("h1", "h1", "h2"), some(2, 10), 1, marks("title", "headline", "entry-title") if chance(0.2) else ""))
        for _ in range(int(rng.integers(1, 12))):
            r = rng.random()
            if r < 0.76:
                body.append(paragraph())
            elif r < 0.82:
                body.append(el(pick("h2", "h3", "h4"), some(1, 6), 1))
            elif r < 0.87:
                body.append(el(pick("ul", "ol"), "".join(el("li", pick(sentence(), some(1, 8)), 1) for _ in range(int(rng.integers(2, 6)))), 1))
            elif r < 0.89:
                body.append(el("blockquote", pick(sentence(), paragraph()), 1))
            elif r < 0.90:
                body.append(el("table", el("tr", el("td", some(1, 5), 1) + el("td", some(1, 5), 1), 1), 1))
            elif r < 0.915:
                body.append(el("figure", "<img src=x>" + el("figcaption", sentence(), 1), 1))
            elif r < 0.93:
                body.append(el("pre", some(2, 12), 1))
            else:
                body.append(extras())
        if chance(0.12):  # many paragraphs of a few words
            body += [el("p", some(1, 4).capitalize() + ".", 1) for _ in range(int(rng.integers(8, 30)))]
        body = "".join(body)
        if chance(0.25):
            body = el(pick("div", "section"), body, 1, marks("article-body", "entry-content", "content", "post-body", "story", "text") if chance(0.7) else "")
        if chance(0.12):
            body += el("footer", sentence(), 0)
        if chance(0.06):
            body = el("header", el("p", some(2, 6), 0), 0) + body
        if chance(0.6):
            out = el("article", body, 1, marks("article", "post", "entry", "story", "hentry") if chance(0.35) else "")
        else:
            out = el(pick("div", "div", "section", "main"), body, 1, marks("content", "main", "article", "post", "entry", "story", "post-content", "main-content", "page", "body", "single"))
        return out + comments() if chance(0.15) else out

    pages = []
    for _ in range(count):
        plain = chance(0.15)
        main = article() + (comments() if chance(0.35) else "")
        if chance(0.35):
            main = (aside() if chance(0.2) else "") + main + (aside() if chance(0.4) else "") + (advert() if chance(0.2) else "")
            main = el(pick("main", "div", "div"), main, 1, marks("container", "wrapper", "page", "main", "content", "layout") if chance(0.8) else "")
        before = "".join(x() for x, p in ((notice, 0.3), (header, 0.5), (menu, 0.7), (advert, 0.45), (form, 0.1), (aside, 0.2)) if chance(p))
        after = "".join(x() for x, p in ((aside, 0.3), (advert, 0.3), (form, 0.15), (comments, 0.15), (footer, 0.8), (notice, 0.15)) if chance(p))
        pages.append(f'<html><head><title>{some(2, 6)}</title></head><body data-y="1">{before}{main}{after}</body></html>')
    return pages


def extract_texts(model: Model, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    return ["\n".join(t for o, t in zip(p.owner, p.texts) if m[o] >= MARGINAL) for p, m in zip(pages, model.content(pages))]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches):
        for b in batches:
            before = np.cumsum([0] + [64 + (len(s) if s else 0) for s in b.column(2).to_pylist()])
            lo = 0
            while lo < b.num_rows:
                most = int(np.searchsorted(before, before[lo] + BATCH_CHARS, "right")) - 1
                part = b.slice(lo, max(1, most - lo))
                lo += part.num_rows
                texts = extract_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(returning(run), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), train([Page(s) for s in labelled_pages()]))
