"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier over a block's ancestors, names,
links and words gives each block a cost for being called content or boilerplate; these
are its terminal capacities.  Neighbouring blocks are joined by an edge, and so are the
blocks of one DOM element, through a node for that element, with a weight that falls
with the distance in the tree.  The maximum flow between the terminals separates content
from boilerplate at least total cost.

Each page is labelled by itself: the work is one pass over the table, without exchange.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose text is never shown, or is part of a control.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select",
          "option", "button", "title", "head", "canvas", "audio", "video", "datalist"}
#: Elements whose content is raw: it ends only at their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag that ends an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
#: What an end tag may not reach out of.
WALLS = {"td", "th", "table", "article", "section", "aside", "nav", "footer", "header", "main", "body"}

#: Weight of an ancestor element for content (positive) or boilerplate.
ELEMENT = {"article": 4.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0,
           "dialog": -8.0, "header": -5.0, "address": -2.0}
OWN = {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "td": 0.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "li": -0.3}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert"
    r"|popup|modal|overlay|menu\w*|nav\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer\w*|masthead|topbar|toolbar"
    r"|comment\w*|disqus|reply|replies|respond|share|sharing|social\w*|related|recommend\w*|newsletter|subscribe"
    r"|signup|login|search|pagination|pager|tags|skip\w*|copyright|legal|disclaimer)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|body|main|text)(?=$|[\s_-])", re.I)
NAME_COST, GOOD_GAIN, LINK_COST = -8.0, 1.5, -5.0
HIDDEN = re.compile(r"\shidden(?=[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Edge weights: next to each other, in one element, and the cut where a section begins.
NEXT, TOGETHER, SECTION = 0.6, 0.4, 0.15
SECTIONS = {"article", "main", "nav", "footer", "aside", "header", "form", "section", "body"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACES = re.compile(r"\s+")


class Element:
    """An open element: name, depth, parent and the classifier's weight of its whole path."""

    __slots__ = ("name", "parent", "weight", "silent", "link", "section", "depth")

    def __init__(self, name: str, parent: Element | None, attrs: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        weight, self.section = ELEMENT.get(name, 0.0), self
        if attrs and name not in ("html", "body"):
            for found in NAMES.finditer(attrs):
                value = found.group(1) or found.group(2) or found.group(3) or ""
                if NAMED.search(value):
                    weight += NAME_COST
                elif GOOD.search(value):
                    weight += GOOD_GAIN
        self.weight = weight + (parent.weight if parent else 0.0)
        self.silent = name in SILENT or bool(attrs and HIDDEN.search(attrs)) or bool(parent and parent.silent)
        self.link = name == "a" or bool(parent and parent.link)
        if parent and name not in SECTIONS:
            self.section = parent.section


class Block:
    __slots__ = ("text", "owner", "linked", "chars")

    def __init__(self, text: str, owner: Element, linked: int, chars: int):
        self.text, self.owner, self.linked, self.chars = text, owner, linked, chars


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order; white space inside a block is one space."""
    root = Element("#", None, "")
    open_, found, parts = root, [], []

    def flush(owner: Element) -> None:
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
            if text:
                while owner.parent and owner.name in INLINE:
                    owner = owner.parent
                found.append(Block(text, owner, sum(len(t.strip()) for t, link in parts if link),
                                   sum(len(t.strip()) for t, _ in parts)))
            parts.clear()

    def close(names: set[str], stop: set[str]) -> Element | None:
        at = open_
        while at.parent and at.name not in names and at.name not in stop:
            at = at.parent
        return at.parent if at.parent and at.name in names else None

    pos = 0
    while True:
        tag = TAG.search(page, pos)
        text = page[pos:tag.start()] if tag else page[pos:]
        if not tag:  # a tag that the end of the page cuts off is no text
            text = re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", text)
        if text and not open_.silent:
            parts.append((text, open_.link))
        if not tag:
            break
        pos = tag.end()
        name = (tag.group(2) or "").lower()
        if not name or not tag.group(4):
            continue
        if name not in INLINE:
            flush(open_)
        elif name in ("br", "img"):
            parts.append((" ", open_.link))
        if tag.group(1):
            if name not in VOID:
                up = close({name}, WALLS - {name} if name not in WALLS else {"html"})
                if up is not None:
                    open_ = up
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            open_ = close(CLOSES[name], (WALLS - CLOSES[name]) | {"ul", "ol", "dl", "div"}) or open_
        elif name in ENDS_P:
            open_ = close({"p"}, WALLS | {"div"}) or open_
        if tag.group(3).endswith("/") and name in ("svg", "math"):
            continue
        open_ = Element(name, open_, tag.group(3))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
            if not end:
                break
            if not open_.silent:
                parts.append((page[pos:end.start()], open_.link))
            pos = end.start()
    flush(open_)
    return found


def odds(block: Block) -> float:
    """The classifier: positive for content."""
    density = block.linked / max(block.chars, 1)
    words = block.text.count(" ") + 1
    score = block.owner.weight + OWN.get(block.owner.name, 0.0) + LINK_COST * density
    return score + min(words, 30) / 30 * 1.5 - 0.5 + (0.3 if block.text[-1] in ".!?\"”»…。" else 0.0)


def _edges(blocks: list[Block]) -> tuple[int, dict[int, dict[int, float]]]:
    """Smoothness edges; nodes after the blocks stand for DOM elements."""
    graph: dict[int, dict[int, float]] = {i: {} for i in range(len(blocks))}

    def join(a: int, b: int, weight: float) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + weight
        graph[b][a] = graph[b].get(a, 0.0) + weight

    nodes: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            same = blocks[i - 1].owner.section is block.owner.section
            join(i - 1, i, NEXT if same else NEXT * SECTION)
        at, weight = block.owner.parent, TOGETHER
        for _ in range(2):
            if at is None or at.parent is None or at.name in ("html", "body"):
                break
            key = id(at)
            if key not in nodes:
                nodes[key] = len(blocks) + len(nodes)
                graph[nodes[key]] = {}
            join(i, nodes[key], weight)
            if at.name in SECTIONS:
                break
            at, weight = at.parent, weight / 2
    return len(blocks) + len(nodes), graph


def content(blocks: list[Block]) -> list[bool]:
    """Which blocks lie on the content side of the minimum cut.

    Flow runs from content terminals to boilerplate terminals.  Searches start at the
    boilerplate side; a search that finds no capacity left has found nodes that belong
    to that side for good.
    """
    n, graph = _edges(blocks)
    rest = [odds(b) for b in blocks] + [0.0] * (n - len(blocks))
    side, tiny = [True] * n, 1e-9
    for start in range(len(blocks)):
        while rest[start] < -tiny and side[start]:
            before, queue, hit = {start: start}, deque([start]), -1
            while queue and hit < 0:
                node = queue.popleft()
                for other in graph[node]:
                    if other not in before and side[other] and graph[other][node] > tiny:
                        before[other] = node
                        if rest[other] > tiny:
                            hit = other
                            break
                        queue.append(other)
            if hit < 0:
                for node in before:
                    side[node] = False
                break
            path, node = [], hit
            while node != start:
                path.append((node, before[node]))
                node = before[node]
            flow = min(rest[hit], -rest[start], *(graph[a][b] for a, b in path))
            rest[hit] -= flow
            rest[start] += flow
            for a, b in path:
                graph[a][b] -= flow
                graph[b][a] += flow
    return side[:len(blocks)]


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by one space; empty if there are none."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, content(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points); columns of these names are replaced.

    Needs ``html``; null or empty html gives empty text.  Every row is read whole and by
    itself, so repeated rows give repeated results; an empty table gives an empty one.
    """
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    keep = [pages[c] for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*keep, F.arrow_udf(run, "string")(pages["html"]).alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
