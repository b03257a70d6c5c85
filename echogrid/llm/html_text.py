"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page as events. Block tags cut it into
lines, each with its text, its tags and its place in the page. The ratio of
text to tags per line is smoothed with a Gaussian; lines above the threshold
form the content clusters. The region of the page that holds most of them, an
article or main element if they lie in one, is taken whole, short lines included,
and so are the blocks of the clusters beside it, but for parts that are marked as
something else. Words of class and id say so only where the whole name does, and not at all
on a page that would have no text without the parts they mark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import text_or_empty

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead title tr ul caption".split()
)
# Elements that hold no running text of the page.
ASIDE = frozenset(
    "aside audio button canvas dialog embed footer form head iframe input menu nav noscript object script select style "
    "svg template textarea title video".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright dialog disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination paywall popup promo promotion related replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# Words that may stand beside a mark in one name and leave it a mark, as in "site-footer" or "comment-list".
PLACES = frozenset(
    "area bar block body bottom box column container content footer global group head inner item items left link links list "
    "main mobile outer page panel primary right row secondary section site slot sticky top unit wrap wrapper".split()
)
# Marks of a page's head; inside an article they mark its headline, which stays.
HEADS = frozenset({"header", "masthead", "banner"})
MAIN = frozenset({"article", "main"})

SIGMA = 1.0
RADIUS = 2
# Share of the content text that the region must hold; the clusters outside it are taken one by one.
REGION_SHARE = 0.8

_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    """An open element; ``node`` is the container it is or lies in, ``marked`` tells of a class or id that marks it."""

    tag: str
    aside: bool
    marked: bool
    inside_main: bool
    node: int


@dataclass
class Line:
    """Text of one block in the container ``node``."""

    node: int
    in_main: bool
    marked: bool
    parts: list[str] = field(default_factory=list)
    tags: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def apart(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Does an element hold something else than the page's text by what HTML itself says?"""
    if tag in ASIDE or (tag == "header" and not in_main):
        return True
    for name, value in attrs:
        if tag not in ("html", "body") and (name == "hidden" or (name == "aria-hidden" and value == "true")):
            return True
        if name == "role" and value and value.lower() in ROLES and not (in_main and value.lower() in HEADS):
            return True
        if name == "style" and value and _HIDDEN.search(value):
            return True
    return False


def named_apart(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Does a class or id mark it as something else? All words of the name are marks, or places beside a mark."""
    if tag in ("html", "body"):
        return False
    marks = MARKS if in_main else MARKS | HEADS
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.split():
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & marks and words <= marks | PLACES | HEADS:
                    return True
    return False


class Lines(HTMLParser):
    """Cuts a page into lines while its events stream by."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Element] = []
        # How many elements of each tag are open, and the container around each container; the page is 0.
        self.open: Counter[str] = Counter()
        self.parent = [0]
        self._open(False)

    def _open(self, tagged: bool) -> None:
        top = self.stack[-1] if self.stack else None
        line = Line(top.node, top.inside_main, top.marked) if top else Line(0, False, False)
        line.tags = int(tagged)
        if self.lines and not self.lines[-1].parts:
            line.tags += self.lines.pop().tags
        self.lines.append(line)

    def _close(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        self.open.subtract(e.tag for e in self.stack[k:])
        del self.stack[k:]

    def _implied(self, tag: str) -> None:
        """Close what a start tag closes without an end tag: an open paragraph, a list or table item of its kind."""
        if tag in BLOCKS and self.stack and self.stack[-1].tag == "p":
            self._close(-1)
        closes = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "body": {"head", "title"}}.get(tag)
        while closes and self.stack and self.stack[-1].tag in closes:
            self._close(-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in BLOCKS and tag not in ASIDE:
            if tag == "br":
                self.lines[-1].parts.append(" ")
                self.lines[-1].tags += 1
                return
            self.lines[-1].tags += 1
            inside = self.lines[-1].in_main
            if tag in VOID or not attrs or not (apart(tag, attrs, inside) or named_apart(tag, attrs, inside)):
                return
        self._implied(tag)
        top = self.stack[-1] if self.stack else Element("", False, False, False, 0)
        aside = top.aside or apart(tag, attrs, top.inside_main)
        marked = top.marked or named_apart(tag, attrs, top.inside_main)
        if tag not in VOID:
            node = top.node
            if tag not in ("p", "li"):
                node = len(self.parent)
                self.parent.append(top.node)
            in_main = top.inside_main or (tag in MAIN and not aside and not marked)
            self.stack.append(Element(tag, aside, marked, in_main, node))
            self.open[tag] += 1
        self._open(True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] > 0 else ():
            if self.stack[k].tag == tag:
                self._close(k)
                self._open(True)
                return
            # An end tag doesn't reach out of the article, nor a paragraph's out of its block.
            if self.stack[k].tag in MAIN and tag not in ("body", "html") or (tag == "p" and self.stack[k].tag in BLOCKS):
                break
        self.lines[-1].tags += 1
        if tag in BLOCKS and tag != "body" and tag != "html":
            self._open(True)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1].aside):
            self.lines[-1].parts.append(data)


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian mean of each value's neighbours; the weights at the ends are those there are."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(values[i + d], kernel[d + radius]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
        out.append(sum(v * k for v, k in pairs) / sum(k for _, k in pairs))
    return out


def content_lines(lines: list[tuple[Line, str]]) -> list[bool]:
    """Lines whose smoothed ratio reaches the threshold, the standard deviation of all."""
    ratios = smooth([len(text) / max(1, line.tags) for line, text in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(deviation, mean)
    return [r >= threshold for r in ratios]


def _chosen(lines: list[tuple[Line, str]], parent: list[int]) -> list[str]:
    """Texts of the region that holds the content clusters, and of the clusters beside it with their blocks."""
    weight = [0] * len(parent)
    total = named = 0
    good = content_lines(lines)
    for (line, text), content in zip(lines, good, strict=True):
        if content:
            total += len(text)
            named += len(text) * line.in_main
            weight[line.node] += len(text)
    # A container comes after the one around it, so sums go up in one walk back, and what holds inside down in one forth.
    for node in range(len(parent) - 1, 0, -1):
        weight[parent[node]] += weight[node]
    region = max(n for n, w in enumerate(weight) if w >= REGION_SHARE * total)
    within = [False] * len(parent)
    within[region] = True
    for node in range(region + 1, len(parent)):
        within[node] = within[parent[node]]
    # The page's own naming counts only where the clusters lie in it.
    by_name = named > 0 and named >= REGION_SHARE * total
    held = [line.in_main if by_name else within[line.node] for line, _ in lines]
    # Content clusters beside the region stay too, with the short lines of their blocks.
    around = [False] * len(parent)
    for (line, _), inside in zip(lines, held, strict=True):
        around[line.node] |= inside
    for node in range(len(parent) - 1, 0, -1):
        around[parent[node]] |= around[node]
    block = [False] * len(parent)
    for (line, _), content, inside in zip(lines, good, held, strict=True):
        block[line.node] |= content and not inside and not around[line.node]
    for node in range(1, len(parent)):
        block[node] |= block[parent[node]]
    return [
        text for (line, text), content, inside in zip(lines, good, held, strict=True) if inside or content or block[line.node]
    ]


def main_text(html: str) -> str:
    """Text of a page's main region, one line a block; empty if there is none.

    Parts that only a class or id marks are left out, unless nothing else is left.
    """
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(line, text) for line in parser.lines if (text := line.text())]
    plain = [x for x in lines if not x[0].marked] or lines
    return "\n".join(_chosen(plain, parser.parent)) if plain else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, in one scan without a shuffle.

    Null or empty html, and a page without text, give the empty text; a null id
    or url stays null. Repeated rows stay. Other columns are ignored; an empty
    table gives an empty result.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=out,
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
