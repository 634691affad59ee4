"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its path of tags (and first classes) from the root. For
each path: characters outside links and punctuation marks for each of its blocks. Both ratios are smoothed over neighbouring
paths in page order and fused as a product. Elements that name themselves something else than an article (menus, forms, by class, id
or role an advert, a notice, comments) lessen the ratios of their paths. Paths above a share of the page's mean, weighted by text, are content.

Content blocks choose the place: the deepest element that holds most of their text. Of it stay: the blocks on content paths; those between
the first and the last of these; the headings before the first; in an article or main element also blocks before and after them
whose path isn't made of links, and list items and paragraphs next to a content block. What names itself something else stays only on a content path. Names that
articles use as well (header, related, side) drop an element only if none of its paths is content.

Reading is linear in the page, whatever is left open or unquoted, and each element is stored once, with its parent's number.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

# Fixed values of HTML: elements without an end tag, raw-text elements, block-level elements, elements that end an open p.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "audio", "video", "title", "select"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
HEADINGS, LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td", "dd"}
#: Elements that hold no article, and words of class, id or role names that say so.
NOT_ARTICLE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "head", "fieldset", "dir", "label"}
WORDS = {
    "nav", "navbar", "navigation", "menu", "menubar", "sidebar", "aside", "ad", "ads", "adv", "advert", "adverts", "advertisement",
    "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notification", "alert",
    "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies", "respond", "footer", "masthead", "breadcrumb",
    "breadcrumbs", "share", "sharing", "social", "recommended", "subscribe", "subscription", "newsletter", "signup", "login", "search",
    "searchbox", "widget", "pagination", "pager", "toolbar", "complementary", "contentinfo", "copyright", "disclaimer", "hidden", "skip",
    "feedback", "responses",
}
#: Words that parts of articles bear as well.
WEAK = {"header", "related", "discussion", "notice", "notices", "side", "tags", "toc", "form", "foot"}

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What may stand in a tag: no quote, or whole quoted values; one that holds < or > must end like a value. No part is tried twice.
_INSIDE = re.compile(r"(?>[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PUNCT = re.compile(r"[.,;:!?…。、，؟¿¡]")
_SPACE = re.compile(r"\s+")


def _named(attrs: str, body: bool) -> tuple[str, int]:
    """Class of the path, and how its names say that an element holds no article: 2 surely, 1 perhaps, 0 not."""
    first, off = "", 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            off = 2
        elif not body and name != "hidden":
            words = set(re.split(r"[\s_-]+", value))
            off = max(off, 2 if words & WORDS else 1 if words & WEAK else 0)
        if name == "class":
            first = value.split()[0] if value.split() else ""
    return first, off


@dataclass
class Page:
    """Blocks in page order, as columns, and the elements they stand in: number 0 is the page, parents come before their children."""

    text: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters of links
    within: list[int] = field(default_factory=list)  # innermost block-level element
    off: list[int] = field(default_factory=list)  # 2: furniture by its names, 1: perhaps
    weak: list[int] = field(default_factory=list)  # the outermost element that perhaps is furniture, or 0
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    path: int  # of the block-level elements down to it
    block: int  # place in the stack of the innermost block-level element
    off: int
    weak: int
    link: bool
    article: bool
    header: bool


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, name with / if it ends, attributes, place after) of each tag; a tag that no > ends reaches to the page's end.

    Where quotes don't match up to a place, tags before it end at their first >, so nothing is read more than twice."""
    at, broken = 0, 0
    while m := _OPEN.search(page, at):
        before = page[at : m.start()]
        if m[4] is None:
            close, size = ("-->", 3) if m[1] else ("]]>", 3) if m[2] else (">", 1)
            end = page.find(close, m.end())
            at = len(page) if end < 0 else end + size
            yield before, "", "", at
            continue
        end = -1
        if m.end() >= broken:
            stop = _INSIDE.match(page, m.end()).end()
            end = stop if page[stop : stop + 1] == ">" else -1
            broken = stop if end < 0 else broken
        if end < 0:
            end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        at = end + 1
        yield before, m[3] + m[4].lower(), page[m.end() : end], min(at, len(page))
    yield page[at:], "", "", len(page)


def blocks(page: str) -> Page:
    found = Page()
    paths: dict[tuple[int, str], int] = {}
    root = _Element("", 0, 0, 0, 0, 0, False, False, False)
    stack, count = [root], Counter()
    run: list[str] = []
    linked, place, skipped, unclosed = 0, root, 0, set()

    def text(piece: str) -> None:
        nonlocal linked, place
        if piece:
            if not run:
                place = stack[-1]
            piece = html.unescape(piece)
            run.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    def close() -> None:
        nonlocal linked
        whole = _SPACE.sub(" ", "".join(run)).strip() if run else ""
        if whole:
            own = owner[place.number]
            found.text.append(whole)
            found.path.append(place.path)
            found.links.append(linked)
            found.within.append(own)
            found.off.append(max(place.off, 2 if place.header and found.tag[own] not in HEADINGS else 0))
            found.weak.append(place.weak)
        run.clear()
        linked = 0

    def pop(upto: int) -> None:
        if stack[-1].block >= upto:
            close()
        for x in stack[upto:]:
            count[x.tag] -= 1
        del stack[upto:]

    owner = [0]  # of each element the innermost block-level one, itself included
    for before, name, attrs, at in _tokens(page):
        if skipped >= at:
            continue
        if skipped < at - len(before) - len(name) - len(attrs):
            text(before)
        if not name:
            continue
        tag = name.lstrip("/")
        if name[0] == "/":
            if count[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            elif tag in BLOCK:
                close()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    skipped = end.end()
                else:
                    unclosed.add(tag)
                    skipped = len(page) if tag in ("script", "style", "textarea", "title") else 0
            continue
        if tag in BLOCK:
            close()
            if stack[stack[-1].block].tag == "p":
                pop(stack[-1].block)
            if any(count[x] for x in ENDS_ITSELF.get(tag, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ENDS_ITSELF[tag]:
                        pop(i)
                        break
                    if stack[i].tag in SCOPE.get(tag, ()):
                        break
        elif tag == "br":
            text(" ")
        if tag in VOID:
            continue
        top, number = stack[-1], len(found.tag)
        first, off = _named(attrs, tag in ("body", "html", "article", "main"))
        off = 2 if tag in NOT_ARTICLE or tag == "header" and not top.article else off
        is_block = tag in BLOCK
        found.tag.append(tag)
        found.parent.append(top.number)
        owner.append(number if is_block else owner[top.number])
        path = paths.setdefault((top.path, f"{tag}.{first}" if first else tag), len(paths) + 1) if is_block else top.path
        weak = top.weak or (number if off == 1 else 0)
        block = len(stack) if is_block else top.block
        stack.append(
            _Element(tag, number, path, block, max(top.off, off), weak, top.link or tag == "a", top.article or tag in ("article", "main"), top.header or tag == "header")
        )
        count[tag] += 1
    close()
    return found


def path_ratios(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Of each block its path's fused ratio, and its path's share of text outside links."""
    order = {p: i for i, p in enumerate(dict.fromkeys(page.path))}
    path = np.array([order[p] for p in page.path])
    size, links = np.array([len(t) for t in page.text]), np.array(page.links)
    n = np.bincount(path).astype(float)
    chars = np.bincount(path, np.maximum(0, size - 2 * links)) / n
    marks = np.bincount(path, [len(_PUNCT.findall(t)) for t in page.text]) / n
    kernel = np.array([0.15, 1.0, 0.15])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") / kernel.sum()
    lessened = np.bincount(path, np.array([0, 0.5, 0.98])[np.array(page.off)]) / n
    fused = smooth(chars) * (1 + smooth(marks)) * np.sqrt(n) * (1 - lessened)
    free = 1 - np.bincount(path, links) / np.bincount(path, size)
    return fused[path], free[path]


def main_text(page: str, share: float = 0.5, most: float = 0.7, linked: float = 0.3) -> str:
    """Text of the article of a page. ``share`` of the mean ratio makes a path content, ``most`` of its text lies in the article; a path with
    less than ``linked`` of its text outside links is made of links."""
    found = blocks(page)
    if not found.text:
        return ""
    fused, free = path_ratios(found)
    size = np.array([len(t) for t in found.text], float)
    within, off = np.array(found.within), np.array(found.off)
    unnamed = size * (off < 2) if (off < 2).any() else size  # the mean is that of what isn't surely furniture
    content = fused >= share * float((fused * unnamed).sum() / unnamed.sum())
    if not content.any():
        return ""
    elements = len(found.tag)
    mass = np.bincount(within[content], size[content], elements)
    for e in range(elements - 1, 0, -1):  # children before their parents
        mass[found.parent[e]] += mass[e]
    place = max((e for e in range(elements) if mass[e] >= most * mass[0] and found.tag[e] in BLOCK), default=0)
    if found.tag[place] in LEAVES:  # a single long block: its parent is the place
        place = found.parent[place]
    inside, article = np.zeros(elements, bool), np.zeros(elements, bool)
    for e in range(elements):
        up = found.parent[e]
        inside[e] = e == place or e > 0 and inside[up]
        article[e] = found.tag[e] in ("article", "main") or e > 0 and article[up]
    weak = np.array(found.weak)
    of_article = np.isin(weak, weak[content & (off < 2)]) | (weak == 0)  # what may be furniture is none where it holds content
    here = inside[within]
    chosen = np.flatnonzero(content & here)
    first, last = (chosen[0], chosen[-1]) if len(chosen) else (0, -1)
    near = content.copy()
    near[1:] |= content[:-1]
    near[:-1] |= content[1:]
    keep = []
    for i in np.flatnonzero(here).tolist():
        heading = i < first and found.tag[within[i]] in HEADINGS
        part = article[place] and (free[i] >= linked or near[i] and found.tag[within[i]] in LEAVES)
        rest = off[i] < 2 and (heading or of_article[i] and (part or first <= i <= last))
        if content[i] or rest:
            keep.append(found.text[i])
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null or empty html gives the empty text; other columns don't matter.

    Narrow: each page by itself.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return run

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_slices(rows, make, "page_id long, url string, text string, n_chars long", "html")
