"""Main text of web pages by minimum-cut labelling of their blocks.

A page's text is cut into blocks at block-level tags. A logistic classifier
gives each block log odds of being content, from its text (length, links,
punctuation), its depth and the names of what stands around it.
They are capacities from the source and to the sink; blocks that follow one
another, and blocks of one parent, are joined by smoothness edges that weigh
less the further the two stand apart in the tree. The minimum cut, by maximum
flow, separates content from the rest.

The classifier is trained on the pages: on a bounded sample (``SAMPLE_PAGES``
pages of at most ``SAMPLE_CHARACTERS`` characters, those with the smallest hashes)
blocks inside an ``article`` element are content and the others are not. That
element is no input. Weights start from ``PRIOR``, and are held near it, so names
that the sample lacks keep their usual meaning; the weight of the edges is the one
of ``EDGE_SCALES`` with which the cut gets most of the sample's blocks right.
Without such pages the prior stands alone.

Defined results: null or empty html, and pages without content, give an empty
text; unclosed and stray tags and quotes are tolerated, and a tag that never ends
counts as text; repeated rows, also of one id, give the same text; null ids are
kept; pages of any length are read whole, in time that grows in proportion; an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spare_names

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li link main menu meta nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio canvas".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
SILENT_TAGS = frozenset("script style noscript template textarea svg math iframe object select button canvas audio video title".split())
#: Elements that an element of the same kind ends.
ITEM_TAGS = frozenset("li dd dt td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())

#: Elements around a block, and their prior weight.
PLACES = {"main": 2.5, "nav": -4.0, "aside": -4.0, "footer": -4.0, "header": -2.5, "form": -4.0, "menu": -4.0, "dialog": -4.0, "head": -8.0}
#: Words in the class, id or role of an element around a block, and their prior weight.
HINTS = [
    (re.compile(r"(^|[^a-z])(ads?|advert\w*|sponsor\w*|promo\w*|banner)([^a-z]|$)"), -4.0),
    (re.compile(r"comment|disqus|repl(y|ies)|discuss"), -4.0),
    (re.compile(r"side-?bar|(^|[^a-z])(side|rail|widget\w*)([^a-z]|$)"), -4.0),
    (re.compile(r"cookie|consent|notice|gdpr|alert|popup|modal|newsletter|subscri|paywall"), -4.0),
    (re.compile(r"(^|[^a-z])(nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc)([^a-z]|$)"), -4.0),
    (re.compile(r"foot(er)?([^a-z]|$)|copyright|masthead|(^|[^a-z])(site|page)-?header"), -4.0),
    (re.compile(r"share|social|related|recommend|trending|popular|login|sign-?up|search"), -3.0),
    (re.compile(r"(^|[^a-z])(article|post|entry|story|content|body|main)([^a-z]|$)"), 1.2),
]
#: Inputs of a block's own, and their prior weights. Its neighbours are the edges' part.
OWN = {
    "bias": -1.2, "length": 0.45, "links": -4.0, "ends": 0.8, "heading": 0.8, "item": -0.5, "depth": 0.0,
}
HIDDEN = -6.0
#: Hashed names of the elements around a block, and of their classes and ids.
NAMES = 128
PLACE_BITS = {tag: 1 << k for k, tag in enumerate(PLACES)}
HIDDEN_BIT = 1 << len(PLACES)
HINT_BITS = [1 << (len(PLACES) + 1 + k) for k in range(len(HINTS))]
#: Marks that make what is around a block no content, whatever element it stands in.
NEGATIVE = sum(PLACE_BITS[t] for t, w in PLACES.items() if w < 0) | HIDDEN_BIT | sum(b for b, (_, w) in zip(HINT_BITS, HINTS, strict=True) if w < 0)
NEGATIVE_HINTS = sum(b for b, (_, w) in zip(HINT_BITS, HINTS, strict=True) if w < 0)
#: Elements that are the whole page; what holds one of the two after them frames the page's text as well. Their classes speak of the page, not of a block.
WHOLE, HELD = frozenset(("html", "body")), frozenset(("main", "article"))
MARKS = len(PLACES) + 1 + len(HINTS)
PRIOR = np.array([*OWN.values(), *PLACES.values(), HIDDEN, *[w for _, w in HINTS], *[0.0] * NAMES])

SAMPLE_PAGES, SAMPLE_CHARACTERS = 400, 50_000
EDGE_SCALES = (0.0, 0.5, 1.0, 2.0, 4.0)
#: How strongly the weights are held near the prior.
HOLD = 2e-3
#: Least weight of the edge of two blocks that follow one another.
FAR = 0.1

_MARK = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_END = re.compile(r"[.!?…:;\"'”)]\W{0,8}$")


@dataclass
class Block:
    text: str
    node: int  # of the element that it stands in
    tag: str
    marks: int  # bits of the places and hints around it
    names: int  # bits of the hashed names around it
    linked: int  # characters inside links
    labelled: bool  # in an article, and in nothing there that is no content


@dataclass
class Page:
    blocks: list[Block]
    parent: list[int]  # of each node
    depth: list[int]


def marks_of(tag: str, attributes: str) -> tuple[int, int]:
    """Place and hint bits, and hashed names, of an element."""
    marks, names = PLACE_BITS.get(tag, 0), 0
    if tag in WHOLE:
        return marks | (HIDDEN_BIT if _HIDDEN.search(attributes) else 0), names
    if tag not in ("article", "p"):
        names |= 1 << zlib.crc32(tag.encode()) % NAMES
    if attributes:
        if _HIDDEN.search(attributes):
            marks |= HIDDEN_BIT
        for found in _NAMED.findall(attributes):
            name = "".join(found).lower()
            for bit, (pattern, _) in zip(HINT_BITS, HINTS, strict=True):
                if pattern.search(name):
                    marks |= bit
            for word in name.split():
                names |= 1 << zlib.crc32(b"." + word.encode("utf-8", "replace")) % NAMES
    return marks, names


@dataclass
class _Open:
    tag: str
    node: int
    block: int  # place on the stack of the nearest block-level element
    marks: int
    names: int
    link: bool
    article: bool
    labelled: bool


def parse(page: str) -> Page:
    """Text blocks in page order. White space inside a block is one space. Every character is passed a bounded number of times."""
    out: list[Block] = []
    parent, depth = [0], [0]
    # Of each element: its own marks, the element around it, whether it frames the page; and each block's innermost element.
    own, around_it, frames, inner = [0], [0], [True], []
    stack = [_Open("", 0, 0, 0, 0, False, False, False)]
    places: dict[str, list[int]] = {}  # where on the stack elements of a name are
    text: list[str] = []
    linked, at, n, quotes = 0, 0, len(page), True

    def flush() -> None:
        nonlocal linked
        if text:
            # The parts are decoded together, so a reference is whole, and split at any white space.
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                top = stack[-1]
                around = stack[top.block]
                inner.append(top.node)
                out.append(Block(words, around.node, around.tag, top.marks, top.names, linked, top.labelled))
            text.clear()
        linked = 0

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def say(part: str) -> None:
        nonlocal linked
        text.append(part)
        if stack[-1].link:
            linked += len(part)

    while at < n:
        start = page.find("<", at)
        if start != at:
            say(page[at:] if start < 0 else page[at:start])
            if start < 0:
                break
            at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            say("<")
            at += 1
            continue
        end = m.end() if m else at + 2
        if m and quotes:  # the end of the tag is the first > outside quotes
            while (stop := _MARK.search(page, end)) and stop[0] != ">":
                end = page.find(stop[0], stop.end()) + 1
                if not end:
                    stop = None
                    break
            if stop is None:  # a quote that never ends: from here on quotes mean nothing
                quotes = False
            else:
                end = stop.start()
        if not (m and quotes):
            end = page.find(">", m.end() if m else at + 2)
            if end < 0:  # no tag ends any more
                say(page[at:])
                break
        attributes, tag, closing = page[m.end() : end] if m else "", m[1].lower() if m else "", page[at + 1] == "/"
        at = end + 1
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag == "br":
            text.append(" ")
        if tag in SILENT_TAGS:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?![a-z0-9-])", re.I).search(page, at)
                at = found.start() if found else n
            text.append(" ")
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag in BLOCK_TAGS:  # a block ends an open paragraph, and an item an open item
            nearest = stack[-1].block
            if stack[nearest].tag == "p" or stack[nearest].tag == tag and tag in ITEM_TAGS:
                close(nearest)
        top = stack[-1]
        marks, names = marks_of(tag, attributes)
        if tag == "header" and (top.article or top.marks & PLACE_BITS["main"]):
            marks &= ~PLACE_BITS["header"]
        if tag in HELD and not marks & NEGATIVE:
            for e in reversed(stack):
                if frames[e.node]:
                    break  # and so does all that holds it
                frames[e.node] = True
        own.append(marks)
        around_it.append(top.node)
        frames.append(tag in WHOLE)
        parent.append(stack[top.block].node)
        depth.append(depth[parent[-1]] + (tag in BLOCK_TAGS))
        places.setdefault(tag, []).append(len(stack))
        article = top.article or tag == "article"
        labelled = article and not marks & NEGATIVE and (top.labelled or not top.article)
        stack.append(_Open(tag, len(parent) - 1, len(stack) if tag in BLOCK_TAGS else top.block, top.marks | marks, top.names | names, top.link or tag == "a", article, labelled))
    flush()
    marks = [0]
    for k in range(1, len(own)):
        marks.append(marks[around_it[k]] | (own[k] & ~NEGATIVE_HINTS if frames[k] else own[k]))
    for b, k in zip(out, inner, strict=True):
        b.marks = marks[k]
    return Page(out, parent, depth)


def features(page: Page) -> np.ndarray:
    """Inputs of the classifier: one row for each block."""
    blocks = page.blocks
    n = len(blocks)
    chars = np.array([len(b.text) for b in blocks], float)
    share = np.minimum(1, np.array([b.linked for b in blocks]) / np.maximum(chars, 1))
    size = np.log1p(chars / 10)
    x = np.zeros((n, len(PRIOR)))
    for k, b in enumerate(blocks):
        x[k, : len(OWN)] = (1, size[k], share[k], _END.search(b.text[-40:]) is not None, b.tag in HEADINGS, b.tag in ITEM_TAGS, min(page.depth[b.node], 30) / 10)
        bits, at = b.marks | b.names << MARKS, len(OWN)
        while bits:
            low = bits & -bits
            x[k, at + low.bit_length() - 1] = 1
            bits ^= low
    return x


def edges_of(page: Page) -> list[tuple[int, int, float]]:
    """Neighbours in page order, by how far apart they stand in the tree, and neighbours among the blocks of one parent."""
    blocks, parent, depth = page.blocks, page.parent, page.depth
    edges = []
    for i in range(len(blocks) - 1):
        a, b, steps = blocks[i].node, blocks[i + 1].node, 0
        while a != b:  # from one to the next all steps of a page are as many as its tree has, twice
            if a > b:
                steps, a = steps + 1, parent[a]
            else:
                steps, b = steps + 1, parent[b]
        edges.append((i, i + 1, max(FAR, 1 / (1 + max(0, steps - 2)))))
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        p = parent[b.node]
        if last.get(p, i - 1) < i - 1:
            edges.append((last[p], i, 0.5))
        last[p] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: cost above 0 from the source, below 0 to the sink.

    Maximum flow by blocking flows on level graphs; then what the source still reaches.
    """
    n = len(costs)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(i: int, j: int, forth: float, back: float) -> None:
        at[i].append(len(to)), at[j].append(len(to) + 1)
        to.extend((j, i)), room.extend((forth, back))

    for i, c in enumerate(costs):
        if c > 0:
            join(s, i, c, 0.0)
        elif c < 0:
            join(i, t, -c, 0.0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in at[i]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        following = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                # Back to before the first edge that is full.
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while following[i] < len(at[i]):
                e = at[i][following[i]]
                if room[e] > 1e-9 and level[to[e]] == level[i] + 1:
                    break
                following[i] += 1
            if following[i] < len(at[i]):
                path.append(at[i][following[i]])
                i = to[path[-1]]
            elif i == s:
                break
            else:
                i = to[path.pop() ^ 1]
                following[i] += 1


@dataclass
class Model:
    weights: np.ndarray
    edge_scale: float = 1.0


def costs_of(page: Page, model: Model) -> list[float]:
    return (features(page) @ model.weights).tolist()


def labels(page: Page, model: Model) -> list[bool]:
    """Which blocks are content."""
    return minimum_cut(costs_of(page, model), [(i, j, w * model.edge_scale) for i, j, w in edges_of(page)]) if page.blocks else []


def fit(pages: list[str], steps: int = 300) -> Model:
    """Weights by gradient steps on the logistic loss, both classes alike, held near the prior; then the scale of the edges."""
    read = [p for p in map(parse, pages) if any(b.labelled for b in p.blocks) and not all(b.labelled for b in p.blocks)]
    if not read:
        return Model(PRIOR.copy())
    x = np.concatenate([features(p) for p in read])
    y = np.array([b.labelled for p in read for b in p.blocks])
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, m, s = PRIOR.copy(), np.zeros(len(PRIOR)), np.zeros(len(PRIOR))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + HOLD * (w - PRIOR)
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    wrong = {}
    for scale in EDGE_SCALES:
        model = Model(w, scale)
        wrong[scale] = sum(a != b.labelled for p in read for a, b in zip(labels(p, model), p.blocks, strict=True))
    return Model(w, min(EDGE_SCALES, key=lambda k: (wrong[k], abs(k - 1))))


def extract(page: str | None, model: Model | None = None) -> str:
    """The content blocks of a page in order, one to a line; by the prior alone without a model."""
    read = parse(page or "")
    return "\n".join(b.text for b, keep in zip(read.blocks, labels(read, model or Model(PRIOR)), strict=True) if keep)


def training_pages(pages: DataFrame, column: str = "html", most: int = SAMPLE_PAGES, characters: int = SAMPLE_CHARACTERS) -> list[str]:
    """The pages with the smallest hashes of those within the bound on characters: ``most`` * ``characters`` on the driver, about.

    A bound on the hash, from the number of pages, leaves about twice as many as are
    wanted, so tasks send next to nothing however many they are.
    """
    page = F.col(column)
    short = pages.where(page.isNotNull() & (F.length(page) <= characters)).select(page.alias("page"), F.pmod(F.xxhash64(page), F.lit(1 << 30)).alias("place"))
    bound = int((1 << 30) * min(1.0, 2 * most / max(1, short.count())))
    # Repeated pages share a hash: they count once, so that they cannot crowd the driver.
    drawn = short.where(F.col("place") < bound).groupBy("place").agg(F.min("page").alias("page"))
    return [r["page"] for r in drawn.orderBy("place").limit(most).collect()]


def learn(pages: DataFrame, column: str = "html") -> Model:
    return fit(training_pages(pages, column))


def main_text(pages: DataFrame, column: str = "html", columns: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """``columns``, ``text, n_chars`` of every page. No shuffle: a page is read, labelled and written in its task."""
    ship(pages.sparkSession)
    model = learn(pages, column) if model is None else model
    (page,) = spare_names(pages, "page")
    kept = pages.select(*columns, F.col(column).alias(page))
    fields = [f for f in kept.schema.fields if f.name != page]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(x, model) for x in batch.pop(page)]
            batch["text"] = text
            batch["n_chars"] = [len(x) for x in text]
            for f in fields:  # whole numbers with nulls arrive as floats
                if f.dataType.typeName() in ("long", "integer"):
                    batch[f.name] = batch[f.name].astype("Int64")
            yield batch

    return kept.mapInPandas(run, schema)
