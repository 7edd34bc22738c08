"""Main text of web pages by tag-path ratios.

A page becomes blocks of text in page order, each in an element with a root-to-leaf path of structural tags. Text length, link
length and punctuation are summed for each path; a path's ratio is its characters per node and its punctuation, fused as
a geometric mean, lowered by the share of links, smoothed over neighbouring paths in page order, and weighed by what the page itself says
of the element: ``BOILERPLATE`` tags and classes, ids or roles all of whose words are ``HINTS`` weigh next to nothing, names that have such a word
among others a little less than plain ones (``MARKED``, ``HINTED``). Paths over a threshold (a part of the mean, weighted by text that is no
link) are content; no tag or word is a veto, so text in an oddly named element is found where it is the page's text. A page whose content has no weight has none.
Around content, the nearest article or main element is its container, or else the content's common ancestor: other blocks of the container that are not
marked stay too (short headings, lists), outside articles if they are not mostly links. The words of html and body are not
looked at, as they tell of the whole page; the document's head and elements that are not displayed are no blocks.

Null and empty html: empty text. Unclosed tags, unclosed comments and stray brackets never fail: the rest is text or is
dropped as a browser would; time grows with the length of a page, however deep it nests. Repeated rows: one result row each. Extra
columns are ignored. An empty table: no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that neither break a block nor enter a path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content up to the end tag is not markup; dropped.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea xmp title noembed noframes select datalist audio video map".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
#: An opening tag on the left closes these open ones.
IMPLIED = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role values that mark what is not the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments respond disqus cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget toolbar pagination pager login search disclaimer".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
PART = 0.3
#: Weights of elements that are boilerplate by tag or name, and of those that may be by a part of their name.
MARKED, HINTED = 1e-6, 0.05

_attributes = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_name = re.compile(r"[A-Za-z][^\s/>]*")
_space = re.compile(r"\s+")
_words = re.compile(r"[a-z]+")
_quoted = re.compile(r"""[^>"']*(?:=\s*(?:"[^"]*"|'[^']*')[^>"']*)*>""")


class Node:
    """An element around text. A page's elements are a tree, so a block needs no copy of what is open around it. ``path``: the
    number of its tag path on this page; ``within``: the nearest article or main element; ``weight``: the least of the elements around; ``gone``: not displayed."""

    __slots__ = ("depth", "gone", "name", "path", "up", "weight", "within")

    def __init__(self, name: str, up: Node | None, weight: float, gone: bool, path: int):
        self.name, self.up, self.path = name, up, path
        self.depth = up.depth + 1 if up else 0
        self.weight = min(weight, up.weight) if up else weight
        self.gone = gone or (up is not None and up.gone)
        self.within = self if name in ("article", "main") else up.within if up else None


class Block:
    __slots__ = ("links", "node", "text")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


def blocks_of(source: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    paths: dict[tuple[int, str, float], int] = {}
    root = Node("", None, 1.0, False, 0)
    stack: list[Node] = [root]
    open_names: dict[str, int] = {}
    unended: set[str] = set()
    text: list[str] = []
    state = {"links": 0, "depth": 0}

    def flush() -> None:
        joined = _space.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append(Block(stack[-1], joined, min(state["links"], len(joined))))
        text.clear()
        state["links"] = 0

    def push(name: str, weight: float, gone: bool) -> None:
        up = stack[-1]
        path = paths.setdefault((up.path, name, min(weight, up.weight)), len(paths) + 1)
        stack.append(Node(name, up, weight, gone, path))
        open_names[name] = open_names.get(name, 0) + 1

    def pop() -> None:
        open_names[stack.pop().name] -= 1

    def close(name: str) -> None:
        if open_names.get(name, 0):
            flush()
            while stack[-1].name != name:
                pop()
            pop()

    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = source[at:lt]
            text.append(piece)
            if state["depth"]:
                state["links"] += len(piece)
        if lt >= size:
            break
        after = source[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _name.match(source, lt + 1 + closing)
        if not m:
            if closing:
                end = source.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text.append("<")
                at = lt + 1
            continue
        name = m[0].lower()
        q = _quoted.match(source, m.end())
        end = q.end() if q else source.find(">", m.end()) + 1
        if end <= 0:
            break
        rest, at = source[m.end() : end - 1], end
        if closing:
            if name == "a":
                state["depth"] = max(0, state["depth"] - 1)
            elif name == "p" and not open_names.get("p", 0):
                flush()
            elif name not in INLINE:
                close(name)
            continue
        if name in RAW:
            stop = None if name in unended else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            if not stop:
                unended.add(name)  # no end tag is left, so none is looked for again
                if name not in ("script", "style"):
                    continue
            at = size if not stop else max(source.find(">", stop.end()) + 1, stop.end())
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            state["depth"] += name == "a" and not rest.endswith("/")
            continue
        flush()
        if name in CLOSES_P and stack[-1].name == "p":
            pop()
        while stack[-1].name in IMPLIED.get(name, ()):
            pop()
        if name == "body":
            while len(stack) > 1 and not (len(stack) == 2 and stack[-1].name == "html"):
                pop()
        if name not in VOID:
            weight, gone = (1.0, False) if name in ("html", "body") else _told(rest)
            if name in BOILERPLATE and not (name == "header" and stack[-1].within):  # an article's own header is the article's
                weight = MARKED
            push(name, weight, gone or name == "head")
            if rest.endswith("/") and name not in CLOSES_P:
                pop()
    flush()
    return out


def _told(attributes: str) -> tuple[float, bool]:
    """The weight of an element by its names, and whether it is not displayed."""
    if "=" not in attributes and "hidden" not in attributes:
        return 1.0, False
    weight = 1.0
    for key, value in _attributes.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                words = _words.findall(token)
                if words and HINTS.issuperset(words):
                    weight = MARKED
                elif not HINTS.isdisjoint(words):
                    weight = min(weight, HINTED)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return weight, True
    return weight, False


def ratios(blocks: list[Block]) -> dict[int, float]:
    """A fused, smoothed and weighed ratio for each path, in page order."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.node.path, [0.0, 0.0, 0.0, 0.0, b.node.weight])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += b.links
        s[3] += 1
    own = [((length / nodes) * (1 + marks) / nodes**0.5) ** 0.5 * length**0.5 * (1 - links / length) ** 2 for length, marks, links, nodes, _ in sums.values()]
    smooth = [0.8 * x + 0.1 * own[max(k - 1, 0)] + 0.1 * own[min(k + 1, len(own) - 1)] for k, x in enumerate(own)]
    return {path: x * s[4] for (path, s), x in zip(sums.items(), smooth, strict=True)}


def _common(nodes: list[Node]) -> Node:
    """The deepest element around all of them. Elements known to be inside it are climbed once."""
    common, inside = nodes[0], {nodes[0]}
    for n in nodes[1:]:
        while n not in inside and n.depth > common.depth:
            inside.add(n)
            n = n.up
        if n in inside:
            continue
        while common is not n:
            if common.depth >= n.depth:
                inside.add(common)
                common = common.up
            else:
                inside.add(n)
                n = n.up
        inside.add(common)
    return common


def _inside(node: Node, top: Node, known: dict[Node, bool]) -> bool:
    """Whether ``top`` is around ``node``; ``known`` keeps the answers."""
    climbed = []
    while node not in known and node.depth > top.depth:
        climbed.append(node)
        node = node.up
    answer = known.get(node, node is top)
    known.update(dict.fromkeys(climbed, answer))
    return answer


def main_text(source: str | None) -> str:
    """The page's main text, blocks joined by newlines."""
    if not source:
        return ""
    blocks = [b for b in blocks_of(source) if not b.node.gone]
    if not blocks:
        return ""
    ratio = ratios(blocks)
    plain = [(len(b.text) - b.links) * b.node.weight for b in blocks]
    threshold = PART * sum(ratio[b.node.path] * n for b, n in zip(blocks, plain, strict=True)) / (sum(plain) or 1.0)
    content = [b for b in blocks if ratio[b.node.path] >= threshold]
    if all(b.node.weight == MARKED for b in content):
        return ""
    chosen = {b.node.within for b in content}
    kept = {id(b) for b in content} | {id(b) for b in blocks if b.node.within in chosen and b.node.within is not None and b.node.weight > MARKED}
    if None in chosen:
        own = [b for b in content if b.node.within is None]
        top = _common([b.node for b in own])
        if top.name not in ("", "html", "body"):
            around: dict[Node, bool] = {}
            for b in blocks:
                if b.node.within is None and b.node.weight > MARKED and 2 * b.links <= len(b.text) and _inside(b.node, top, around):
                    kept.add(id(b))
    return "\n".join(b.text for b in blocks if id(b) in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(h.decode("utf-8", "replace") if h else None) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
