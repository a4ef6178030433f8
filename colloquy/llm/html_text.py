"""Main text of web pages by minimum-cut labelling of their blocks.

A page is scanned into text blocks and the elements around them. A logistic classifier looks at a block's own text: its
length, links, sentence ends and tag give log odds of being content, which become capacities to the two terminals. What
the page says about its parts becomes nodes of the same graph: an element that is a menu, footer, form, article or the like, by
its tag or by its class or id, is a node with a capacity of its own. Smoothness edges join each block to the nearest such
element around it, an element to the next one outwards, and blocks that follow each other, the more the closer they are in
the element tree. The minimum cut labels all nodes at once: a short line of an article stays with it although it looks
like nothing by itself, and a long text in a sidebar goes. Names that often mean something else, as "search" or "header",
have little capacity, so that the text inside can outvote them.

Nodes whose terminal capacity exceeds all their edges keep their label in every minimum cut and are settled first;
maximum flow runs on what is left, which is short even for very long pages. The scan is linear, however badly tags nest.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var br wbr img math mi mn mo mtext mrow msup msub msubsup mfrac msqrt mroot mstyle semantics "
    "svg g text tspan".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p blockquote pre figcaption dd dt td th li summary caption".split())
BARRIERS = frozenset("article body main nav footer aside table".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset option".split())
#: Words of class, id and role names that mark what is not the article.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus feedback footer masthead menu menubar modal nav navbar navigation newsletter "
    "pagination popup promo promoted promotion recommend recommended related replies reply respond responses share sharing "
    "sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary gdpr".split()
)
#: Words that mark it in some names and mean something else in others.
PERHAPS = frozenset("alert form header login notice notices search skip social tags toc tools".split())
TOWARDS = frozenset("article content entry main post story body text".split())
#: Words that turn a name into one of a layout around the article.
LAYOUT = frozenset("has with without no layout wrapper wrap container page".split())

# Capacities of elements: settled ones, and those that their text can outvote.
SURE, SOFT, LIKELY = 1e9, 2.0, 3.0
# The classifier's weights.
W_BASE, W_LENGTH, W_LINKS, W_SENTENCE, W_MARK = 0.1, 1.0, -3.5, 0.5, -2.0
W_TAG = dict.fromkeys(("p", "blockquote", "pre"), 0.5) | dict.fromkeys(HEADINGS, 0.3) | {"li": -0.4}
#: Smoothness: a block and the element around it (menus and the like, articles, others), an element and the next outwards,
#: blocks that follow each other (under one parent, in one element, else).
OUT, IN, PART, NEST = 6.0, 4.5, 3.0, 1.0
KIN, NEXT, FAR = 1.0, 0.6, 0.1

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_SIMPLE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}


def named(tag: str, attributes: str) -> float:
    """What an element's names say, as a capacity: negative for what is not the article, 0 if nothing or both.

    A name is read word by word. An id counts if all of it is known words, since ids also name what a text is about; names
    of paragraphs and headings do not count, but for comments and adverts by class.
    """
    worst, best = 0.0, 0.0
    for m in _NAMES.finditer(attributes):
        kind = m[1].lower()
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [p.lower() for p in _PARTS.findall(name)]
            known = set(words)
            if known & LAYOUT and known & (AWAY | PERHAPS):
                continue
            if kind == "id" and not known <= AWAY | PERHAPS | TOWARDS:
                continue
            away, perhaps, towards = known & AWAY, known & PERHAPS, known & TOWARDS
            if tag in HEADINGS or tag in TEXTUAL:
                away = away if kind == "class" and len(words) == 1 else set()
                perhaps = towards = set()
            if away and (not towards or words[-1] in AWAY or words[0] in AWAY):
                worst = -SURE
            elif perhaps and not towards:
                worst = min(worst, -SOFT)
            elif towards:
                best = LIKELY
    return worst or best


class _Element:
    """``node`` is the nearest element around, or this one, that is a node of the graph."""

    __slots__ = ("tag", "node", "outside", "article")

    def __init__(self, tag: str, attributes: str, parent: _Element | None, nodes: list[tuple[float, int]]):
        self.tag = tag
        self.node, self.outside, self.article = (parent.node, parent.outside, parent.article) if parent else (-1, False, False)
        says = named(tag, attributes) if "=" in attributes and tag not in ("html", "body", "main") else 0.0
        if tag in BOILERPLATE:
            says = -SURE
        elif tag == "header" and not self.article:
            says = says or -2 * SOFT
        elif tag == "noscript":
            says = says or -SOFT
        elif tag in ("article", "main") and says >= 0 and not self.outside:
            says, self.article = SURE, True
        elif self.article and -SURE < says < 0 and "header" in attributes.lower():
            says = 0.0  # an article's own header
        if says:
            nodes.append((says, self.node))
            self.node = len(nodes) - 1
            self.outside = self.outside or says == -SURE


def blocks(html: str) -> tuple[list[tuple[str, int, _Element, int]], list[tuple[float, int]]]:
    """Text blocks in page order: white space made single, the characters of it that are links, the element around and its
    number; then the elements that are nodes, each with its capacity and the next one outwards."""
    nodes: list[tuple[float, int]] = []
    stack = [_Element("", "", None, nodes)]
    solid, numbers, opened, barriers = [0], [0], {}, []  # places on the stack: not inline; by tag; of barriers
    out: list[tuple[str, int, _Element, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    keys = 0

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, len(" ".join(unescape("".join(linked)).split())), stack[solid[-1]], numbers[-1]))
            parts.clear()
            linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if opened.get("a"):
            linked.append(text)

    def push(tag: str, attributes: str) -> None:
        nonlocal keys
        keys += 1
        opened.setdefault(tag, []).append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
            numbers.append(keys)
        stack.append(_Element(tag, attributes, stack[-1], nodes))

    def drop(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            opened[tag].pop()
            if barriers and barriers[-1] == len(stack):
                barriers.pop()
            if solid[-1] == len(stack):
                solid.pop()
                numbers.pop()

    at, n, read = 0, len(html), _TAG
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        follows = html[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            end = html.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        m = read.match(html, lt) if follows.isalpha() or follows == "/" else None
        if not m and read is _TAG and follows.isalpha():
            read = _SIMPLE  # a quote never closes: from here on they are not heeded
            m = read.match(html, lt)
        if not m:
            if follows.isalpha() or follows == "/":
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                say("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag not in INLINE:
                close()
            if places := opened.get(tag):
                if tag not in INLINE or not barriers or barriers[-1] < places[-1]:
                    drop(places[-1])
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                gt = html.find(">", end.end()) if end else -1
                at = gt + 1 if gt >= 0 else n
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag not in INLINE:
            close()
            kinds = ("p",) if tag in CLOSES_P else (tag, "p") if tag in ("li", "dd", "dt", "tr", "td", "th", "option") else ()
            if stack[solid[-1]].tag in kinds:
                drop(solid[-1])
        if m[3].endswith("/") and tag in INLINE:
            continue
        push(tag, m[3])
    close()
    return out, nodes


def log_odds(text: str, links: int, tag: str) -> float:
    """What a block's own text says."""
    size = len(text)
    odds = W_BASE + W_TAG.get(tag, 0.0) + W_LENGTH * max(-0.5, min(2.0, math.log(size / 60))) + W_LINKS * links / size
    if text[-1] in ".!?\u2026\u3002:;\"\u201d":
        odds += W_SENTENCE
    return odds + (W_MARK if "\u00a9" in text else 0.0)


def graph(found: list[tuple[str, int, _Element, int]], nodes: list[tuple[float, int]]) -> tuple[list[float], list[dict[int, float]]]:
    """Log odds and edges of the blocks, then of the elements."""
    n = len(found)
    odds = [log_odds(text, links, e.tag) for text, links, e, _ in found] + [c for c, _ in nodes]
    near: list[dict[int, float]] = [{} for _ in odds]
    for i, (_, _, e, key) in enumerate(found):
        if e.node >= 0:
            c = nodes[e.node][0]
            near[i][n + e.node] = near[n + e.node][i] = OUT if c <= -SURE else IN if c >= SURE else PART
        if i:
            _, _, before, other = found[i - 1]
            near[i][i - 1] = near[i - 1][i] = FAR if e.node != before.node else KIN if key == other or e.tag == before.tag else NEXT
    for j, (_, outer) in enumerate(nodes):
        if outer >= 0:
            near[n + j][n + outer] = near[n + outer][n + j] = NEST
    return odds, near


def _flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source side of the minimum cut among ``nodes``: Dinic's algorithm on the residual graph."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {v: dict(near[v]) for v in nodes}
    cap[s], cap[t] = {}, {}
    for v in nodes:
        if odds[v] > 0:
            cap[s][v], cap[v][s] = odds[v], 0.0
        else:
            cap[v][t], cap[t][v] = -odds[v], 0.0
    while True:
        depth, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        if t not in depth:
            return set(depth) - {s}
        left = {u: list(cap[u]) for u in depth}
        while True:  # blocking flow, path by path without recursion
            path = [s]
            while path and path[-1] != t:
                u = path[-1]
                while left[u] and not (cap[u][left[u][-1]] > 1e-12 and depth.get(left[u][-1], -9) == depth[u] + 1):
                    left[u].pop()
                if left[u]:
                    path.append(left[u][-1])
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()
            if not path:
                break
            pushed = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
            for a, b in zip(path, path[1:], strict=False):
                cap[a][b] -= pushed
                cap[b][a] = cap[b].get(a, 0.0) + pushed


def minimum_cut(odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """True where a node is on the side of positive log odds in a minimum cut."""
    odds, near = list(odds), [dict(x) for x in near]
    label: dict[int, bool] = {}
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if i in label or abs(odds[i]) < sum(near[i].values()) or odds[i] == 0 and near[i]:
            continue
        label[i] = odds[i] > 0
        for j, c in near[i].items():  # a settled node is a terminal for its neighbours
            odds[j] += c if label[i] else -c
            del near[j][i]
            queue.append(j)
        near[i] = {}
    seen: set[int] = set()
    for i in range(len(odds)):
        if i in label or i in seen:
            continue
        part, todo = [], [i]
        seen.add(i)
        while todo:
            u = todo.pop()
            part.append(u)
            new = [v for v in near[u] if v not in seen]
            seen.update(new)
            todo += new
        content = _flow(part, odds, near)
        label.update((u, u in content) for u in part)
    return [label[i] for i in range(len(odds))]


def main_text(html: str | None) -> str:
    """Content blocks in page order, joined by one line break."""
    found, nodes = blocks(html or "")
    keep = minimum_cut(*graph(found, nodes))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All other columns but the html, and ``text``, ``n_chars`` (code points).

    Null or empty html gives an empty text; pages are cut off nowhere; a page that breaks off inside a tag or comment
    loses that tag or comment only; repeated rows are extracted each; columns named ``text`` or ``n_chars`` are replaced.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*others).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*others, "text", "n_chars"],
            )

    return pages.select(*others, html_col).mapInArrow(run, schema)
