"""Main text of web pages by line-block distribution.

A page is stripped to lines, one per block of text. Lines inside menus, forms, scripts, adverts, comments and the like
are set aside whatever their length, and characters inside links do not count. The number of characters in a sliding
window of ``WINDOW`` lines surges where text begins and dives, below a share of what the region had so far, where it ends;
what lies between the first surge and the last dive is kept, but for lists of links. Short lines next to it are kept
unless they are as many as a window: those are a menu. If the page marks its article and most of the main surge lies
inside, the lines inside are the text, but for lists of links; other marks (teasers) are not looked at.

The work is linear in the page: what is open is known by counters and by the places of each name on the stack.
"""

from __future__ import annotations

import html
import itertools
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import python_ready, table

WINDOW = 3
SURGE = 80    # characters in a window from which on a region is text
DIVE = 0.1    # share of a region's windows so far (three surges a window at most) below which it has ended

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

# Text in these is never shown, or ends only at the closing tag.
_OPAQUE = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math"}
# Page furniture, whatever its text.
_FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "title", "button",
}
# Blocks that end an open paragraph.
_ENDS_P = _BLOCK - {"br", "option", "button", "title"}
# Whole names in a class or id; "no-sidebar" or "has-comments" speak of something else.
_NAMED = re.compile(
    r"(?:ads?|advert\w*|adslot|adsense|banner|sponsor\w*|promo\w*|promotion\w*|side-?bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|foot|footer|masthead|site-?header|page-?header|topbar|comments?|comment-?\w*|respond|replies|disqus\w*|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|"
    r"recirc|widget|pagination|pager|toolbar|copyright|legal|disclaimer|skip-?link|search\w*|tags?|paywall)"
    r"(?:[_-]+(?:\d+|area|bar|block|bottom|box|buttons?|container|content|items?|left|links?|list|menu|right|section|slot|top|unit|widget|wrap|wrapper))*", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
          "menubar", "toolbar", "note"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(
        re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))


def _is_furniture(name: str, attributes: dict[str, str], in_article: bool, by_name: bool) -> bool:
    if name in _FURNITURE or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main", "article") or re.fullmatch(r"h[1-6]", name):
        return False
    if attributes.get("role", "").lower() in _ROLES or _is_hidden(attributes):
        return True
    return by_name and any(_NAMED.fullmatch(token) for k in ("class", "id") for token in attributes.get(k, "").split())


class Line(NamedTuple):
    text: str
    links: int       # characters inside links
    article: bool    # in the marked article
    furniture: bool
    heading: bool

    @property
    def is_link(self) -> bool:
        return 2 * self.links >= len(self.text)


class _Open(NamedTuple):
    """An open element, with what holds inside it."""

    name: str
    furniture: bool
    article: bool
    hidden: bool
    heading: bool
    link: bool
    enclosed: bool  # in an element that is furniture by its kind


_OUTSIDE = _Open("", False, False, False, False, False, False)
# What a stray closing tag of an inline element does not reach beyond, and what a paragraph that is still open lies in.
_WALLS = ("article", "main", "section", "div", "table", "body")
_HOLDERS = (*_WALLS, "li", "td")
_INLINE = {"p", "span", "b", "i", "em", "strong", "a"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Stack:
    """Open elements; the last place of each name is known without a search."""

    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> _Open:
        return self.open[-1] if self.open else _OUTSIDE

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, element: _Open) -> None:
        self.places.setdefault(element.name, []).append(len(self.open))
        self.open.append(element)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().name].pop()


def lines_of(page: str, by_name: bool = True) -> list[Line]:
    """Lines of a page in order. ``by_name``: classes and ids tell furniture, too."""
    lines: list[Line] = []
    held: list[tuple[str, bool]] = []
    stack = _Stack()

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join([x for x, _ in held]))).strip()
        if text:
            links = "".join([x for x, link in held if link])
            top = stack.top()
            lines.append(Line(text, len(_SPACE.sub(" ", html.unescape(links)).strip()) if links else 0,
                              top.article, top.furniture, top.heading))
        held.clear()

    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            held.append((page[at:], stack.top().link))
            break
        if match.start() > at:
            held.append((page[at:match.start()], stack.top().link))
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK or name == "template":
            flush()
        if match[1]:
            place = stack.last(name)
            # A stray closing tag inside a section does not close what is around the section.
            if place >= 0 and (name not in _INLINE or place > stack.last(*_WALLS)):
                stack.cut(place)
            continue
        if name in _OPAQUE:
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closing.end() if closing else size
            continue
        if name in _VOID or match[3].endswith("/") and name not in _BLOCK:
            continue
        if name in _ENDS_P and (place := stack.last("p")) > stack.last(*_HOLDERS):
            # An open paragraph, with whatever inline elements are open in it, ends here.
            stack.cut(place)
        around = stack.top()
        # An article ends the furniture around it, unless it is itself hidden or lies in a menu, form or the like.
        furniture = around.enclosed or around.hidden if name in ("article", "main") else around.furniture
        attributes = _attributes(match[3])
        furniture = furniture or _is_furniture(name, attributes, around.article, by_name)
        stack.push(_Open(
            name, furniture, around.article or name in ("article", "main") and not furniture,
            around.hidden or _is_hidden(attributes), around.heading or name in _HEADINGS, around.link or name == "a",
            around.enclosed or name in _FURNITURE))
    flush()
    return lines


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """Stretches of lines (start, end) from each surge of the windowed length to the next dive.

    The window at a line sums it and the lines after; a region begins at the first line with text of a window that
    reaches ``surge``, and ends where a window falls below the share ``dive`` of the region's mean so far, in which no
    window counts for more than three surges.
    """
    blocks, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        blocks[i] = total
    # A page with less text than a surge is its own region.
    surge = max(1, min(surge, max(blocks, default=0)))
    found, start, seen = [], -1, 0
    for i, block in enumerate(blocks):
        if start < 0 and block >= surge and lengths[i]:
            start, seen = i, 0
        if start >= 0 and i > start and block < max(1, dive * seen / (i - start)):
            found.append((start, i))
            start = -1
        if start >= 0:
            seen += min(block, 3 * surge)
    return found + ([(start, len(lengths))] if start >= 0 else [])


def _first_line(lines: list[Line], lengths: list[int], start: int) -> int:
    """Where a text begins that surges at ``start``: short lines before its first long one belong to it if they are
    fewer than a window, and so do headings before it with fewer than a window of other lines between.
    """
    first = next((i for i in range(start, len(lines)) if 2 * lengths[i] >= SURGE), start)
    run = first
    while run > 0 and 0 < 2 * lengths[run - 1] < SURGE and not lines[run - 1].is_link:
        run -= 1
    begin = run if first - run < WINDOW else first
    others = first - begin
    for i in range(begin - 1, -1, -1):
        if lines[i].heading:
            begin, others = i, 0
        elif not lines[i].is_link:
            others += 1
            if others >= WINDOW:
                break
    return begin


def _last_line(lines: list[Line], end: int) -> int:
    """Where a text ends that dives at ``end``: fewer short lines after it than a window belong to it."""
    run = end
    while run < len(lines) and not lines[run].is_link:
        run += 1
    return run if run - end < WINDOW else end


def main_text(page: str | None) -> str:
    """The article of a page, its blocks in order joined by one blank; null, empty and textless pages: empty."""
    lines = lines_of(page or "")
    if all(line.furniture for line in lines):
        # Names that leave nothing of the page do not name furniture.
        lines = lines_of(page or "", by_name=False)
    lines = [line for line in lines if not line.furniture]
    lengths = [0 if line.is_link else len(line.text) - line.links for line in lines]
    if not any(lengths):
        # A page of links only is told by its lengths.
        lengths = [len(line.text) for line in lines]
    found = regions(lengths)
    if not found:
        return ""
    # The marks of a page are believed if most of its main surge lies inside.
    start, end = max(found, key=lambda r: sum(lengths[r[0]:r[1]]))
    inside = sum(n for n, line in zip(lengths[start:end], lines[start:end]) if line.article)
    if 2 * inside > sum(lengths[start:end]):
        kept = [line for line in lines if line.article]
    else:
        kept = lines[_first_line(lines, lengths, found[0][0]):_last_line(lines, found[-1][1])]
    return " ".join(line.text for line in _without_link_lists(kept))


def _without_link_lists(lines: list[Line]) -> list[Line]:
    """The lines without runs of links as long as a window; of links alone, all are text."""
    if all(line.is_link for line in lines):
        return lines
    kept = []
    for is_link, run in itertools.groupby(lines, key=lambda line: line.is_link):
        run = list(run)
        if not is_link or len(run) < WINDOW:
            kept += run
    return kept


def _texts(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty pages give the empty text; ids and urls may be null or repeat; pages of any length are read whole;
    an empty table gives no rows; other columns are not looked at. Unclosed tags end with the page.
    """
    python_ready(pages)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
