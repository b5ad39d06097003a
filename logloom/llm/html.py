"""Main text of web pages by line-block distribution.

Markup is stripped with every block-level element on a line of its own. A line weighs its
length; lines in menus, headers, footers, sidebars, notices, adverts, forms and comments
(told by tag, role and the words of class and id) weigh nothing, nor do lines outside the marked
articles where these hold a third of the text or more. The weights are summed over a window of ``reach``
lines. The text starts at the first surge, where the sum rises to the threshold and the line has its share
of it, and ends at the last such line before the sum dives for good. The threshold is ``least`` characters, or
``share`` of the page's largest sum where that is less, whatever the length of its longest
paragraph. From both points the text reaches over the lines of the same container (short
paragraphs at the ends) and over headings in front. All lines between that are in no such
place stay, but for runs of lines that are nothing but links.

A form that holds an article or most of the page is its wrapper and excludes nothing. A class or
id excludes by a word for such a place at its end (``cookie-notice``) or at its start before a word for a
part (``share-buttons``), not otherwise (``share-price``, ``has-sidebar``). Null, empty and text-free pages
give an empty string. Unclosed elements end with their container; an unclosed element whose content isn't text (object,
iframe and the like) hides nothing. Pages are independent rows, so repeated rows, null ids and
extra columns change nothing; the cost is linear in the page and nothing is cut.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.scratch import small_batches

_RAW = re.compile(r"<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(svg|iframe|object|textarea|select)\b[^>]*>.*?</\2\s*>|<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>", re.I | re.S)
_HEAD = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside dialog menu button fieldset option optgroup".split())
_PLACES = frozenset("ad ads advert adverts advertisement advertisements banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe signup share sharing social related recommended comment comments respond disqus replies pagination pager toolbar skiplink".split())
_HEADERS = frozenset("header siteheader pageheader topbar".split())
_PARTS = frozenset("area bar block body bottom box button buttons container content form group icons inner item items left link links list main message overlay panel popup posts right section slot stories text thread title tools top unit wrap wrapper".split())
_LAYOUT = frozenset("has with without no is not js show hide".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements without text of their own; closed ones are gone before, an unclosed one hides nothing.
_HOLLOW = frozenset("svg iframe object textarea select".split())
_ARTICLE = frozenset(["article", "main"])
_WHITE = re.compile(r"\s+")
_P_CLOSERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr tbody thead figcaption figure blockquote summary details ul ol dl table section header address".split())
_HEADINGS = frozenset("h1 h2 h3".split())


def _place(value: str, headers: bool) -> bool:
    """Whether a class or id names a place that is no text of an article."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in _LAYOUT:
            continue
        for known in (_PLACES, _HEADERS) if headers else (_PLACES,):
            if words[-1] in known or (words[0] in known and all(w in _PARTS or w.isdigit() for w in words[1:])):
                return True
    return False


class _Line(NamedTuple):
    text: str
    linked: bool  # nothing but links
    bad: bool
    article: int
    form: int
    within: int  # the container
    heading: bool


class _Lines:
    """One pass over the tags: the page's lines, each with its evidence."""

    def __init__(self, page: str):
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.link = 0
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.bad = self.links = self.made = 0
        self.article = self.inside = self.form = 0
        at = 0
        for m in _TAG.finditer(page):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            self.tag(bool(m[1] or m[4]), (m[2] or m[5]).lower(), m[3] or m[6] or "")
        self.text(page[at:])
        self.flush()

    def text(self, raw: str) -> None:
        t = _html.unescape(raw)
        if self.links:
            self.link += len(_WHITE.sub("", t))
        self.parts.append(t)

    def within(self) -> int:
        """The innermost element that holds more than this line: an article, or a block above the leaves and one division."""
        if self.inside:
            return -self.article
        k = len(self.stack) - 1
        if k >= 0 and self.stack[k][0] == "div":
            k -= 1
        while k >= 0 and self.stack[k][0] in _LEAF:
            k -= 1
        return self.stack[k][3] if k >= 0 else 0

    def flush(self) -> None:
        if self.parts:
            t = _WHITE.sub(" ", "".join(self.parts)).strip()
            if t:
                linked = self.link >= len(_WHITE.sub("", t))
                self.lines.append(_Line(t, linked, self.bad > 0, self.article if self.inside else 0, self.form if self.open["form"] else 0, self.within(), bool(self.stack) and self.stack[-1][0] in _HEADINGS))
            self.parts, self.link = [], 0

    def pop(self) -> str:
        name, bad, art, _ = self.stack.pop()
        self.open[name] -= 1
        self.bad -= bad
        self.inside -= art
        return name

    def tag(self, closing: bool, name: str, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.links = max(0, self.links + (-1 if closing else 1 if not self.links else 0))
            return
        inline = name in _INLINE
        if not inline:
            self.flush()
            self.links = 0
        if closing:
            # an inline end tag never closes a block around it
            if self.open[name] and not (inline and self.stack[-1][0] != name):
                while self.pop() != name:
                    pass
            return
        if name in _VOID or name in _HOLLOW or attrs.rstrip().endswith("/"):
            return
        if name in _P_CLOSERS:
            while self.stack and self.stack[-1][0] in ("option", "optgroup"):
                self.pop()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    while len(self.stack) > k:
                        self.pop()
                    break
                if self.stack[k][0] not in _INLINE:
                    break
        art = name in _ARTICLE
        bad = name in _DROP or (name == "header" and not self.inside)
        if attrs and not bad:
            for key, value in _ATTR.findall(attrs):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    bad |= not art and name != "body" and _place(value, not self.inside)
                elif key == "role":
                    bad |= value.lower() in _ROLES
                    art |= value.lower() in ("main", "article")
                elif key == "hidden":
                    bad = True
                elif key == "aria-hidden":
                    bad |= value.lower() == "true"
                else:
                    bad |= "display:none" in value.replace(" ", "").lower()
        if inline and not bad:
            return
        if inline:
            self.flush()
        art = bool(art) and not bad
        if art and not self.inside:
            self.article += 1
        if name == "form":
            self.form += 1
        self.made += 1
        self.stack.append((name, bad, art, self.made))
        self.open[name] += 1
        self.bad += bad
        self.inside += art


def _eligible(lines: list[_Line], marked: float = 1 / 3) -> list[bool]:
    """Lines in no place that is excluded."""
    size = lambda ok: sum(len(x.text) for x in lines if not x.bad and ok(x))
    total = size(lambda x: True)
    wrappers = {0, *(x.form for x in lines if x.article)}
    wrappers |= {f for f in {x.form for x in lines} - wrappers if 2 * size(lambda x: x.form == f) > total}
    inside = size(lambda x: x.article and x.form in wrappers)
    only = inside > 0 and inside >= marked * size(lambda x: x.form in wrappers)
    return [not x.bad and x.form in wrappers and (bool(x.article) or not only) for x in lines]


def main_text(page: str | None, reach: int = 3, share: float = 0.2, least: int = 86) -> str:
    """The main text: blocks in page order, joined by two line feeds."""
    if not page:
        return ""
    page = _RAW.sub(" ", page) if re.search(r"</head\s*>", page, re.I) or not re.search(r"<head\b", page, re.I) else _RAW.sub(" ", re.sub(r"<head\b[^>]*>.*?(?=<body\b|\Z)", " ", _HEAD.sub(" ", page), flags=re.I | re.S))
    lines = _Lines(page).lines
    stays = _eligible(lines)
    lines = [x for x, ok in zip(lines, stays, strict=True) if ok]
    # links alone weigh nothing, but in an article
    weight = [0 if x.linked and not x.article else len(x.text) for x in lines]
    sums = [sum(weight[max(0, i - reach + 1) : i + reach]) for i in range(len(weight))]
    need = max(1.0, min(least, share * max(sums, default=0)))
    over = [i for i, x in enumerate(sums) if x >= need and weight[i] >= need / reach]
    if not over:
        return ""
    first, last = over[0], over[-1]
    while first and weight[first - 1] and (lines[first - 1].within == lines[first].within or lines[first - 1].heading):
        first -= 1
    while last + 1 < len(lines) and weight[last + 1] and lines[last + 1].within == lines[last].within:
        last += 1
    menu = lambda i: not weight[i] and not (weight[i - 1] and weight[i + 1])
    return "\n\n".join(lines[i].text for i in range(first, last + 1) if not menu(i))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars``."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
