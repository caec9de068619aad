"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block tags, each with its
root-to-leaf path (the block tags that are open, with their first class).  For
every path of the page text length and punctuation are added up:

* length ratio: characters a block of the path has on average, those in links counted off;
* punctuation ratio: punctuation marks a block of the path has on average.

Both are smoothed along the page (each block's ratio with its neighbours', by
fixed Gaussian weights, then averaged again a path), fused to one score,
``length * (1 + punctuation)``, and thresholded at ``SPREAD`` standard
deviations of the page's path scores.  The blocks of the paths that pass are
seeds.  The content node is found from the root by going down to the child that
holds ``MOST`` of the seeds' text, down to a node marked as the article or to the
element that holds the paragraphs, and from there up to headings that stand before it.
All its blocks are returned, headings and short paragraphs too, but for those of
paths whose text is mostly links.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are left
out by their tag, role or a word of their class or id before ratios are taken;
a ``header`` inside an article is part of it.  Scripts, styles, templates and
hidden elements hold no text.

Malformed pages: tags that HTML closes by itself are closed (``p`` by a block, ``li``
by ``li`` and so on), stray end tags and unknown markup are ignored, a tag or
comment that is cut off by the end of the page ends it.  Null or empty html gives
an empty text, and so does a page without content.  Each row of the input gives one row;
null ids and urls are kept; other columns are ignored; an empty table gives an
empty result.  A page is handled whole, however long, in time linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import ship_package
from symdex.llm.words import sliced

#: Weights of a block's neighbours at distance 0, 1, 2.
WEIGHTS = tuple(math.exp(-(d**2) / 2) for d in range(3))
SPREAD = 0.5
MOST = 0.7

# Fixed values of HTML: which elements have no end tag, hold no readable text, start a block, end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math select textarea title head".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption "
    "address nav header footer aside form fieldset legend details summary dialog menu center hgroup search button hr".split()
)
CLOSED_BY = {
    "p": BLOCK - {"html", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
}
#: An end tag and an implied end do not reach out of these.
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
ASIDE_TAGS = frozenset("nav aside footer form dialog menu button search".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail widget footer header masthead topbar toolbar "
    "comment comments disqus reply replies related recommended share sharing social newsletter subscribe subscription signup login search form".split()
)
#: Words that a wrapper of the whole page may bear as well.
LAYOUT_WORDS = frozenset("ads banner nav menu sidebar aside rail header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A word before one of those that says the element only has it beside itself.
BESIDE = frozenset("has with no without is not".split())
ARTICLE_CLASSES = frozenset("article-body article-content article-text post-body post-content entry-content story-body articlebody".split())

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MARK = re.compile(r"[.,;:!?…。、，！？؟।]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    """An open block element: its place in the tree, its path, whether it is marked as beside the content or as the article."""

    __slots__ = ("tag", "parent", "path", "beside", "layout", "article", "depth")

    def __init__(self, tag: str, parent: _Node | None, path: int = 0, beside: bool = False, layout: _Node | None = None, article: bool = False):
        self.tag, self.parent, self.path, self.beside, self.article = tag, parent, path, beside, article
        self.layout = layout  # the innermost element around it that a layout word left out
        self.depth = parent.depth + 1 if parent else 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _aside_word(names: str) -> str | None:
    """The first or the last word of a class or an id, if it names a part beside the content."""
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in BESIDE:
            for w in (words[0], words[-1]):
                if w in ASIDE_WORDS:
                    return w
    return None


def _opened(tag: str, attributes: str, parent: _Node, paths: dict[tuple[int, str], int]) -> _Node:
    """The new element below ``parent``; ``paths`` numbers the paths of the page."""
    own = _attributes(attributes) if attributes.strip() else {}
    classes, role = own.get("class", ""), own.get("role", "").lower()
    beside = tag in ASIDE_TAGS or (tag == "header" and not parent.article) or role in ASIDE_ROLES
    beside = beside or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(own.get("style", "")))
    layout = False
    if not beside and tag == "article":
        beside = any(c in ASIDE_WORDS for c in classes.lower().split())
    elif not beside and tag not in ("html", "body", "main"):
        word = _aside_word(classes) or _aside_word(own.get("id", ""))
        in_head = parent.article or tag in HEADINGS  # the article's own heading
        beside = word is not None and not (in_head and word in ("header", "masthead"))
        layout = beside and word in LAYOUT_WORDS
    article = not beside and (tag == "article" or own.get("itemprop", "").lower() == "articlebody" or bool(ARTICLE_CLASSES.intersection(classes.lower().split())))
    if tag == "main" or (tag == "article" and article):  # a wrapper named after its layout holds the content
        up = parent.layout
        while up is not None and up.beside:
            up.beside, up = False, up.parent.layout
    path = paths.setdefault((parent.path, " ".join([tag, *classes.split()[:1]])), len(paths) + 1)
    node = _Node(tag, parent, path, beside, parent.layout, parent.article or article)
    if layout:
        node.layout = node
    return node


def blocks_of(page: str) -> list[tuple[_Node, str, int]]:
    """(element, text, characters of it in links) of every block that is not left out, in page order."""
    root = _Node("", None)
    at, blocks, pieces, linked, links, place = root, [], [], 0, 0, 0
    paths: dict[tuple[int, str], int] = {}
    n_open: Counter[str] = Counter()

    def text_until(end: int) -> None:
        nonlocal linked
        if end > place:
            piece = html.unescape(page[place:end])
            pieces.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    def block_ends() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((at, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal at, links
        if not n_open[tag]:
            return
        node, kept = at, HOLDS.get(tag, ())
        while node is not root and node.tag != tag and node.tag not in kept:
            node = node.parent
        if node.tag == tag and node is not root:
            block_ends()
            while at is not node.parent:
                n_open[at.tag] -= 1
                at = at.parent
            links = 0

    while m := _TAG.search(page, place):
        text_until(m.start())
        place, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not (tag in ("svg", "math") and (m[3] or "").endswith("/")):  # to the end of the element, or of the page
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(page, place)
                body = re.compile(r"<body\b", re.I).search(page, place) if tag == "head" else None
                if body and (end is None or body.start() < end.start()):
                    place = body.start()
                elif end or tag != "head":
                    place = end.end() if end else len(page)
        elif tag == "a":
            links = 0 if m[1] else 1
        elif tag == "br" or tag == "wbr":
            if tag == "br":
                pieces.append(" ")
        elif tag in BLOCK:
            if m[1]:
                close(tag)
                continue
            while at.tag in CLOSED_BY and tag in CLOSED_BY[at.tag]:
                close(at.tag)
            if tag in CLOSED_BY and tag != "p":
                for other in [t for t, ends in CLOSED_BY.items() if tag in ends and t != "p"]:
                    close(other)
            block_ends()
            if tag not in VOID:
                at = _opened(tag, m[3] or "", at, paths)
                n_open[tag] += 1
                links = 0
    text_until(len(page))
    block_ends()
    beside = {root: False}
    return [b for b in blocks if not _known(b[0], beside, lambda node: node.beside)]


def _known(node: _Node, known: dict[_Node, bool], own: Callable[[_Node], bool]) -> bool:
    """Whether ``own`` holds for the element or one it stands in, up to those that are known."""
    chain = []
    while node not in known:
        chain.append(node)
        node = node.parent
    held = known[node]
    for n in reversed(chain):
        known[n] = held = held or own(n)
    return held


def path_scores(blocks: list[tuple[_Node, str, int]]) -> dict[int, float]:
    """Length and punctuation a path, smoothed along the page and fused."""
    sums: dict[int, list[int]] = {}
    for node, text, linked in blocks:
        own = sums.setdefault(node.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(text) - linked
        own[2] += len(_MARK.findall(text))
    ratios = [(sums[node.path][1] / sums[node.path][0], sums[node.path][2] / sums[node.path][0]) for node, _, _ in blocks]
    smooth: dict[int, list[float]] = {path: [0.0, 0.0] for path in sums}
    for i, (node, _, _) in enumerate(blocks):
        near = [(WEIGHTS[abs(d)], ratios[i + d]) for d in range(-2, 3) if 0 <= i + d < len(blocks)]
        total = sum(w for w, _ in near)
        for k in (0, 1):
            smooth[node.path][k] += sum(w * r[k] for w, r in near) / total
    scores = {}
    for path, (n, length, marks) in sums.items():
        # a path's own ratio counts as much as its surroundings'
        length, marks = (length + smooth[path][0]) / (2 * n), (marks + smooth[path][1]) / (2 * n)
        scores[path] = length * (1 + marks) if sums[path][1] else 0.0
    return scores


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    scores = path_scores(blocks)
    if not scores or max(scores.values()) <= 0:
        return ""
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    cut = min(SPREAD * spread, max(scores.values()))
    passed = {path for path, s in scores.items() if s > 0 and s >= cut}
    linked: dict[int, list[int]] = {}
    for node, text, in_links in blocks:
        own = linked.setdefault(node.path, [0, 0])
        own[0] += in_links
        own[1] += len(text)
    menus = {path for path, (in_links, n) in linked.items() if 2 * in_links > n}

    # the seeds' text and the blocks that are no headings, in every element, from the deepest up
    children: dict[_Node, list[_Node]] = {}
    levels: dict[int, list[_Node]] = {}
    direct: Counter[_Node] = Counter()
    plain: Counter[_Node] = Counter()
    seeds: Counter[_Node] = Counter()
    for node, text, _ in blocks:
        if node not in plain:
            levels.setdefault(node.depth, []).append(node)
        plain[node] += node.path not in menus and node.tag not in HEADINGS
        if node.path in passed:
            direct[node] += len(text)
            seeds[node] += len(text)
    for depth in range(max(levels), 0, -1):
        for node in levels.get(depth, ()):
            if node.parent not in plain:
                levels.setdefault(depth - 1, []).append(node.parent)
            plain[node.parent] += plain[node]
            seeds[node.parent] += seeds[node]
            children.setdefault(node.parent, []).append(node)
    content = top = levels[0][0]
    while children.get(content) and not content.article:
        best = max(children[content], key=lambda c: seeds[c])
        if seeds[best] < MOST * seeds[top] or 2 * direct[best] > seeds[best]:
            break
        content = best
    while not content.article and content.parent is not None and plain[content.parent] == plain[content]:
        content = content.parent  # up to the headings that stand before it
    inside = {top: False, content: True}
    return "\n".join(text for node, text, _ in blocks if node.path not in menus and _known(node, inside, lambda n: False))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html): the main text of each page; one map, no shuffle."""
    ship_package(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
