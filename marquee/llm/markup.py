"""Blocks of text of one HTML page: a tag scan that reads each character a bounded number of times, and a stack of open elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

_RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe"}
_RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in _RAW}
_SIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "promotion",
    "related", "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
# words that say nothing of what an element holds: a name of these and of _SIDE alone is a boilerplate name
_NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "buttons", "center", "col", "column", "container", "content", "form", "group", "inner",
    "item", "items", "left", "links", "list", "main", "middle", "outer", "page", "panel", "right", "section", "signup", "site",
    "slot", "text", "thread", "top", "unit", "wrap", "wrapper", "articles", "posts", "stories", "topics",
}
_NAMING = {"class", "id", "role", "aria-label"}
_MAIN = {"article", "main"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "canvas"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TABLE = {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_BLOCKS = _MAIN | _DROPPED | _HEADINGS | _TABLE | {
    "address", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "header",
    "hgroup", "hr", "html", "legend", "li", "ol", "p", "pre", "section", "summary", "table", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}

# what an opening tag ends, and the elements beyond which it ends nothing
_CELL = {"table", "td", "th", "caption"}
_LIST = _CELL | {
    "ul", "ol", "menu", "dl", "section", "article", "main", "aside", "nav", "header", "footer", "form", "fieldset", "details", "dialog",
    "blockquote", "figure",
}
_ENDED = {
    "li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, _LIST), "dd": ({"dt", "dd"}, _LIST), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{name: ({"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for name in ("thead", "tbody", "tfoot")},
}
_ENDS = {name: (ended, barrier - ended) for name, (ended, barrier) in _ENDED.items()}
_PARAGRAPH = _CELL | {"button", "object"}


def _scope(name: str) -> set[str]:
    """The elements that an end tag does not reach across."""
    if name == "table":
        return set()
    if name in _TABLE:
        return {"table"}
    return _CELL | {"ul", "ol"} if name == "li" else _CELL


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, in order; comments and elements of raw text come as one piece without name.

    A ``>`` inside a quoted attribute value does not end a tag. Where the quote is never closed, the first ``>`` does; the quotes up to there are
    not tried again. What is opened and never ends reaches to the end of the page.
    """
    at, size, plain_until = 0, len(page), 0
    last = {c: page.rfind(c) for c in "\"'>"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1 if last[">"] > start else size
            yield start, at, "", False, ""
            continue
        m = _NAME.match(page, start)
        if m is None or last[">"] < m.end():
            at = start + 1
            continue
        end, place = -1, m.end()
        while start >= plain_until and (stop := _STOP.search(page, place)):
            quote = stop[1]
            if quote is None:
                end = stop.end()
                break
            closed = page.find(quote, stop.end()) if last[quote] >= stop.end() else -1
            if closed < 0:
                break
            place = closed + 1
        if end < 0:
            plain_until = max(plain_until, place)
            end = page.find(">", m.end()) + 1
        name, closing, attributes = m[1].lower(), page[start + 1] == "/", page[m.end() : end - 1]
        at = end
        if name in _RAW and not closing and not (name == "svg" and attributes.endswith("/")):
            over = _RAW_END[name].search(page, end)
            at = size if over is None or last[">"] < over.end() else page.find(">", over.end()) + 1
            yield start, at, "", False, name
            continue
        yield start, end, name, closing, attributes


def beside(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element holds something beside the article: by its tag, the words of its class, id and role, or as hidden.

    Outside an article one boilerplate word in a name is enough. Inside, a name counts only if all its words are boilerplate or neutral
    ones (``ad-slot``, ``comment-list``, not ``article-header`` or ``related-work``); a heading never goes by its name, a header is the article's own.
    """
    if name in _DROPPED or (name == "header" and not in_main):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if key == "style" and _NO_DISPLAY.search(value):
            return True
        if key not in _NAMING:
            continue
        for token in value.lower().split():
            words = {w for w in re.split(r"[^a-z]+", token) if w}
            if not in_main:
                if words & _SIDE:
                    return True
            elif name not in _HEADINGS and words <= _SIDE | _NEUTRAL and words & _SIDE - {"header"}:
                return True
    return False


class _Open:
    """The open elements, with the places of each name, so that no tag looks through the whole stack."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.skipped: list[int] = []
        self.main = 0
        self.skip = 0  # number of the last element beside the article
        self.inner = 0  # article elements inside it

    def highest(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, skip: bool) -> None:
        at = len(self.names)
        self.names.append(name)
        self.places.setdefault(name, []).append(at)
        if name in _BLOCKS:
            self.blocks.append(at)
        if self.skipped:
            self.inner += name in _MAIN
        elif skip:
            self.skipped.append(at)
            self.skip, self.inner = self.skip + 1, 0
        else:
            self.main += name in _MAIN

    def cut(self, size: int) -> None:
        """End all elements from place ``size`` on."""
        while len(self.names) > size:
            name = self.names.pop()
            self.places[name].pop()
            if name in _BLOCKS:
                self.blocks.pop()
            if self.skipped and self.skipped[-1] == len(self.names):
                self.skipped.pop()
            elif self.skipped:
                self.inner -= name in _MAIN
            else:
                self.main -= name in _MAIN


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks of text inside the article, in no marked place, and beside it, each in page order.

    End tags may lack where HTML allows it (li, dt, dd, p, table parts); any other element ends with its parent at the latest. An
    end tag without its element, or beyond a table cell, ends nothing. An article inside an element beside it that has no end tag
    of its own is the article all the same.
    """
    found: list[tuple[str, int, bool]] = []  # text, element beside the article (0: none), inside an article
    closed: set[int] = set()
    buffer: list[str] = []
    opened = _Open()

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            found.append((text, opened.skip if opened.skipped else 0, (opened.inner if opened.skipped else opened.main) > 0))

    def end_from(size: int) -> None:
        if size < len(opened.names):
            if (opened.blocks and opened.blocks[-1] >= size) or (opened.skipped and opened.skipped[-1] >= size):
                flush()
            opened.cut(size)

    at = 0
    for start, end, name, closing, attributes in tags(page):
        buffer.append(page[at:start])
        at = end
        if not name:
            continue
        block = name in _BLOCKS
        if closing:
            if block:
                flush()
            place = opened.places.get(name)
            limit = opened.highest(_scope(name)) if block else opened.blocks[-1] if opened.blocks else -1
            if place and place[-1] > limit:
                if opened.skipped and opened.skipped[-1] == place[-1]:
                    closed.add(opened.skip)
                end_from(place[-1])
            continue
        if name == "br":
            buffer.append(" ")
        if opened.names and opened.names[-1] == "head" and name not in _IN_HEAD:
            end_from(len(opened.names) - 1)
        if block:
            flush()
            if name not in _TABLE and name not in ("html", "body"):
                p = opened.highest({"p"})
                if p > opened.highest(_PARAGRAPH):
                    end_from(p)
        if name in _ENDS:
            ended, barrier = _ENDS[name]
            limit = opened.highest(barrier)
            places = [opened.places[n][-1] for n in ended if opened.places.get(n) and opened.places[n][-1] > limit]
            # a table's row ends its cells too: the outermost of them inside the nearest table
            if places:
                end_from(min(places) if name in _TABLE else max(places))
        if name in _VOID or attributes.endswith("/"):
            continue
        skip = not opened.skipped and beside(name, attributes, opened.main > 0)
        if skip and not block:
            flush()
        opened.push(name, skip)
    buffer.append(page[at:])
    flush()
    zones: tuple[list[str], list[str], list[str]] = ([], [], [])
    for text, skip, in_article in found:
        out = skip and not (in_article and skip not in closed)
        zones[2 if out else 0 if in_article else 1].append(text)
    return zones
