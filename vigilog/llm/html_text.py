"""Main text of web pages by tag-path ratios.

Every text node belongs to the path of tags from the root to it. Per path, text length and
punctuation per node and their spread are taken; the fused values are smoothed along the
page and those above a share of their standard deviation mark content. The smallest region
that holds all of the content is the article: all its text is returned but for parts whose
tag or class says that they are something else.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from math import exp, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, map_rows, text_bytes

ops = Registry()

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr nobr".split()
)
APART = frozenset(
    "nav header footer aside form script style noscript template head title button select option textarea input iframe "
    "svg math object embed canvas audio video menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words of class and id attributes that name parts beside the article, and those that name the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header masthead footer foot comment comments commentlist respond reply "
    "replies disqus cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget widgets toolbar pagination pager skip "
    "copyright disclaimer hidden".split()
)
ARTICLE = frozenset("article content main post entry story body text page".split())
ALWAYS = frozenset("ad ads advert comment comments footer header menu nav sidebar share related".split())
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SCOPE = frozenset("article aside section div main body html table td th ul ol dl form nav header footer blockquote".split())
MARKS = re.compile(r"[.,;:!?…。，；：！？、]")
SIGMAS = 0.5  # content is above so many standard deviations

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


class _Node:
    __slots__ = ("tag", "parent", "path", "apart", "children", "weight", "heading")

    def __init__(self, tag: str, parent: _Node | None, label: str, apart: bool) -> None:
        self.tag, self.parent, self.apart = tag, parent, apart
        self.path = f"{parent.path}/{label}" if parent else label
        self.children: list = []  # nodes, and texts as str
        self.weight = 0
        self.heading = False


def _is_apart(tag: str, found: dict[str, str]) -> bool:
    if tag in APART or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for key in ("class", "id"):
        words = {w.lower() for w in _WORDS.findall(found.get(key, ""))}
        beside = words & BESIDE
        if beside and not words & {"has", "with", "no", "wrap", "wrapper"} and (not words & ARTICLE or beside & ALWAYS):
            return True
    return False


def tree(page: str) -> _Node:
    """Elements and texts of a page; script, style and the like are left out."""
    root = node = _Node("", None, "", False)
    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            node.children.append(page[at:])
            break
        if tag.start() > at:
            node.children.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        if tag["end"] or tag["end2"]:
            up = node
            while up is not root and up.tag != name:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        attrs = tag["attrs"] if tag["name"] else tag["attrs2"]
        if name in VOID:
            if name in ("br", "hr"):
                node.children.append(" " if name == "br" else _Node("hr", node, "hr", True))
            continue
        closing = "p" if name in CLOSES_P else None
        for group in filter(None, (closing, CLOSED_BY.get(name))):
            up = node
            while up is not root and up.tag not in group.split() and up.tag not in SCOPE - {"td", "th"} - set(group.split()):
                up = up.parent
            if up is not root and up.tag in group.split():
                node = up.parent
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _NAMED.finditer(attrs)} if attrs.strip(" /") else {}
        kind = _WORDS.search(found.get("class", ""))
        child = _Node(name, node, name + (f".{kind[0].lower()}" if kind else ""), node.apart or _is_apart(name, found))
        node.children.append(child)
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path", "use"):
            node = child
    return root


def _texts(root: _Node) -> list[tuple[_Node, str]]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            found.append(node)
        elif not node.apart:
            for child in reversed(node.children):
                stack.append((node, child) if isinstance(child, str) else child)
    return [(node, text) for node, text in found if not text.isspace()]


def content_nodes(texts: list[tuple[_Node, str]], sigmas: float = SIGMAS) -> list[tuple[_Node, int]]:
    """The text nodes that the path ratios take for content, with their lengths."""
    paths: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for node, text in texts:
        block = node
        while block.tag in INLINE and block.parent is not None and block.parent.parent is not None:
            block = block.parent
        own = (len(text.strip()), len(MARKS.findall(text)))
        sizes.append((block.path, own[0]))
        paths.setdefault(block.path, []).append(own)
    value = {}
    for path, own in paths.items():
        n = len(own)
        length, marks = sum(x for x, _ in own) / n, sum(y for _, y in own) / n
        spread = sqrt(sum((x - length) ** 2 for x, _ in own) / n)
        value[path] = length * (1 + marks) * (1 + spread / (1 + length))
    raw = [value[path] for path, _ in sizes]
    kernel = [exp(-k * k / 2) for k in range(3)]
    smooth = []
    for i in range(len(raw)):
        total = weight = 0.0
        for k in range(-2, 3):
            if 0 <= i + k < len(raw):
                total += kernel[abs(k)] * raw[i + k]
                weight += kernel[abs(k)]
        smooth.append(total / weight)
    if not smooth:
        return []
    mean = sum(smooth) / len(smooth)
    border = min(sigmas * sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)), mean)
    return [(node, size) for (node, _), (_, size), s in zip(texts, sizes, smooth) if s >= border]


def main_text(page: str) -> str:
    """The article of a page as one line of text; empty if there is none."""
    root = tree(page)
    texts = _texts(root)
    chosen = content_nodes(texts)
    total = 0
    for node, size in chosen:
        total += size
        while node is not None:
            node.weight += size
            node = node.parent
    for node, _ in texts:
        up = node
        while up is not None and up.tag not in ("h1", "h2"):
            up = up.parent
        while up is not None and not up.heading:
            up.heading = True
            up = up.parent
    region = root
    while region.tag not in ("article", "main"):
        inner = [c for c in region.children if isinstance(c, _Node)]
        best = max(inner, key=lambda c: c.weight, default=None)
        if best is None or best.tag in INLINE or best.tag == "p" or best.weight < total or not total:
            break
        if region.heading and not best.heading and region.tag not in ("", "html"):
            break
        region = best
    parts: list[str] = []
    stack: list = [region]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.apart:
            mark = [] if item.tag in INLINE else ["\n"]
            stack += mark + list(reversed(item.children)) + mark
        elif item.tag not in INLINE:
            parts.append("\n")
    return " ".join(html.unescape("".join(parts)).split())


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; ids and urls are carried, nulls too; each row stands
    alone, so repeated rows give equal rows; other columns don't matter.
    """

    def make() -> Callable:
        def work(rows: dict[str, list]) -> dict[str, list]:
            texts = [main_text(h.decode("utf-8", "replace")) for h in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    return map_rows(rows, make, "page_id bigint, url string, text string, n_chars bigint")


@ops.add()
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{folder}/pages.parquet"))
