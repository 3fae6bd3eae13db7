"""Main text of web pages from streaming parser events.

The standard library's parser streams start tags, end tags and text. Block boundaries cut
the page into lines; every line knows its text, the tags in it, how much of it is link text,
and its container. Scripts, styles and form controls never become a line. Each line's text-to-tag
ratio is smoothed with a Gaussian over the neighbouring lines; lines at or above a threshold
of the smoothed ratios' standard deviation are clustered as content. The content regions are the
page's own article and main elements with clustered lines, each cut to the innermost one that holds
all of its clusters; on a page without them the region is the lowest container that holds all
clusters. Lines that are mostly links do not widen a region. All lines of the regions stay, however
short, lists of links included; what markup does not rule out there is not dropped.

Markup that names boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) takes the weight from its lines, unless it wraps the page's content: a marked element
that holds half or more of what the page's own article and main elements hold keeps its weight, and so does one
by layout words or a form that holds ``MOST`` of the page's content by weight, or inside an article or main element of that element's. On
elements of running text only a class all of whose words are marks counts. If nothing is left, all
lines count again and the ratio alone decides.

A container knows its parent, and weights are summed from the last container to the first, so the
work is linear in the page, however deep it nests.

Cases: null and empty pages give an empty text; pages without any line at the threshold
keep all lines that markup does not rule out; unclosed, crossed and stray tags are repaired
as they stream, a head without its end tag ends where its content cannot be one; equal lines and equal ratios are judged alike, by their place; repeated rows are extracted row by row; a
very long page is one row's work, in memory linear in its length; an empty table gives an empty
result; white space, no-break spaces included, becomes one space; other columns of the
input stay outside, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title select textarea button iframe object svg math canvas audio video datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
DROPPED = SILENT | BOILERPLATE
CONTAINERS = frozenset("html body main article section div td th table tbody tr blockquote center".split())
BLOCKS = CONTAINERS | DROPPED | frozenset("header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre figure figcaption address details summary hr br thead tfoot caption option hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head, whose end tag may be left out: anything else ends it. What ends a control that nobody closed.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
CONTROLS, ENDING = ("select", "button", "datalist"), frozenset("body main article section header footer nav".split())
#: Elements of running text: on these a class has to be made of marks alone.
TEXTUAL = HEADINGS | frozenset("p li dt dd pre blockquote figcaption summary".split())
#: Words in class, id or role that mark boilerplate; those of ``LAYOUT`` also name wrappers of whole pages.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar sidenav
    menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist respond
    disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations widget widgets pagination pager search searchbox contentinfo complementary
    skip paywall disclaimer""".split()
)
LAYOUT = frozenset("sidebar header nav menu search widget widgets banner social share skip modal overlay paywall subscription alert footer".split())
OWN = frozenset("article entry post story title has with no without".split())
SIGMA, SPAN = 1.0, 2
#: The share of a page's content, as a fraction, beyond which a marked element is its wrapper.
MOST = (2, 3)
#: What a container's markup says: nothing, boilerplate, or boilerplate by words that also name wrappers.
PLAIN, MARKED, WRAPPER = 0, 1, 2


def _marked(attrs: list[tuple[str, str | None]], textual: bool = False) -> int:
    """Whether class, id or role name boilerplate; a header of the article itself is none."""
    found = PLAIN
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return MARKED
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                parts = re.split(r"[^a-z0-9]+", token)
                named = MARKS.intersection(parts)
                if textual and not named.issuperset(parts):
                    continue
                if named and (OWN.isdisjoint(parts) or not {"comment", "comments", "ad", "ads", "share", "nav", "footer", "related"}.isdisjoint(parts) and {"has", "with", "no", "without"}.isdisjoint(parts)):
                    if not named <= LAYOUT:
                        return MARKED
                    found = WRAPPER
    return found


#: Tags at which the search for an open paragraph or list item, and that for any other open element, ends.
_WALL = CONTAINERS - {"tr", "td", "th"} | {"ul", "ol", "dl"} | DROPPED
_WALLS = CONTAINERS | DROPPED


class Lines(HTMLParser):
    """Streams a page into ``lines``: (text, characters outside links, tags, container). Of container k,
    ``parents[k]`` is the one around it, ``own[k]`` whether it is an article or main element, ``marks[k]`` what its markup says."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.own, self.marks = [0], [False], [PLAIN]
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether it is silent, the container around it or -1
        self.open: dict[str, list[int]] = {}  # places of each open tag in the stack
        self.wall: list[int] = []
        self.walls: list[int] = []
        self.at = self.silent = self.links = self.tags = self.plain = 0
        self.text: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.plain, self.tags, self.at))
        self.text, self.tags, self.plain = [], 0, 0

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, silent, around = self.stack.pop()
            self.open[tag].pop()
            if tag in _WALL:
                self.wall.pop()
            if tag in _WALLS:
                self.walls.pop()
            self.silent -= silent
            self.links -= tag == "a"
            if around >= 0:
                self.at = around

    def last(self, tags: tuple[str, ...], after: int = -1) -> int:
        """The place of the last open one of ``tags``, if it is after ``after``."""
        place = max([self.open[t][-1] for t in tags if self.open.get(t)], default=-1)
        return place if place > after else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if self.open.get("head") and tag not in IN_HEAD:
                self.pop_to(self.open["head"][-1])
            if tag in ENDING and (place := self.last(CONTROLS)) >= 0:
                self.pop_to(place)
        if tag in BLOCKS:
            self.end_line()
            if tag in ("p", "li", "dt", "dd") or tag in HEADINGS or tag in CONTAINERS:
                # An open paragraph ends where a block begins; a list item where its sibling does.
                closes = ("p", "li") if tag == "li" else ("p", "dt", "dd") if tag in ("dt", "dd") else ("p", tag) if tag in ("tr", "td", "th") else ("p",)
                if (place := self.last(closes, self.wall[-1] if self.wall else -1)) >= 0:
                    self.pop_to(place)
        self.tags += 1
        if tag in VOID:
            return
        silent = tag in SILENT
        inside = tag == "header" and self.last(("article", "main")) >= 0
        mark = WRAPPER if tag == "form" else MARKED if tag in BOILERPLATE or (tag == "header" and not inside) else PLAIN
        if not silent and not mark and attrs and not inside and tag not in ("html", "body", "main"):
            mark = _marked(attrs, tag in TEXTUAL)
        around = -1
        if not silent and (mark or tag in CONTAINERS):
            around, self.at = self.at, len(self.parents)
            self.parents.append(around)
            self.own.append(not mark and (tag in ("article", "main") or any(n == "itemprop" and v == "articleBody" or n == "role" and v == "main" for n, v in attrs)))
            self.marks.append(mark)
        place = len(self.stack)
        self.open.setdefault(tag, []).append(place)
        if tag in _WALL:
            self.wall.append(place)
        if tag in _WALLS:
            self.walls.append(place)
        self.stack.append((tag, silent, around))
        self.silent += silent
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        bound = -1 if tag in _WALLS or tag == "header" or not self.walls else self.walls[-1]
        if (place := self.last((tag,), bound)) >= 0:
            self.pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self.pop_to(len(self.stack) - 1)
        if not self.silent:
            self.text.append(data)
            if not self.links:
                self.plain += len(data.strip())


def smooth(ratio: np.ndarray, sigma: float = SIGMA, span: int = SPAN) -> np.ndarray:
    """Gaussian smoothing over ``span`` lines to either side, edges renormalised."""
    kernel = np.array([math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-span, span + 1)])
    full = lambda v: np.convolve(v, kernel)[span : span + len(v)]
    return full(ratio) / full(np.ones(len(ratio)))


def _summed(weight: list[int], parents: list[int]) -> list[int]:
    """The weight of each container with all that it holds; a container comes after its parent."""
    out = list(weight)
    for k in range(len(out) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def _ruled_out(p: Lines) -> list[bool]:
    """Of each container, whether its markup or that of one around it takes the weight from its lines."""
    n = len(p.parents)
    if not any(p.marks):
        return [False] * n
    weight = [0] * n
    for text, plain, _, k in p.lines:
        if 2 * plain >= len(text):
            weight[k] += plain
    # In an own element, or under a mark without layout words: from the first container to the last.
    within, strict = list(p.own), [m == MARKED for m in p.marks]
    for k in range(1, n):
        within[k] |= within[p.parents[k]]
        strict[k] |= strict[p.parents[k]]
    own = _summed([w if i else 0 for w, i in zip(weight, within, strict=True)], p.parents)
    apart = _summed([0 if out else w for w, out in zip(weight, strict, strict=True)], p.parents)
    every = _summed(weight, p.parents)
    around = [-1] * n  # the innermost own element around each container
    for k in range(1, n):
        around[k] = p.parents[k] if p.own[p.parents[k]] else around[p.parents[k]]
    out = [False] * n
    for k in range(1, n):
        mark = p.marks[k]
        if not mark:
            wraps = False
        elif (e := around[k]) >= 0:
            # Inside an own element: by layout words what holds most of it, by others what holds most where nothing else is left.
            wraps = MOST[1] * apart[k] >= MOST[0] * apart[e] > 0 if mark == WRAPPER else apart[e] == 0 < MOST[0] * every[e] <= MOST[1] * every[k]
        else:
            wraps = 2 * own[k] >= own[0] > 0 or mark == WRAPPER and own[0] == 0 and MOST[1] * apart[k] >= MOST[0] * apart[0] > 0
        out[k] = out[p.parents[k]] or bool(mark and not wraps)
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    out = _ruled_out(p)
    lines = [x for x in p.lines if not out[x[3]]] or p.lines
    if not lines:
        return ""
    ratio = np.array([plain / max(1, tags) for _, plain, tags, _ in lines], dtype=float)
    even = smooth(ratio)
    content = even >= min(float(even.std()), float(even.max()))
    # What a region has to hold: the lines of the clusters, without those that are mostly links.
    core = [0] * len(p.parents)
    for (t, plain, _, k), on in zip(lines, content.tolist(), strict=True):
        core[k] += on and 2 * plain >= len(t.replace(" ", ""))
    held = _summed(core, p.parents)
    # The outermost own element around each container, and of those with clustered lines the innermost
    # own element that holds as many; without any the lowest container that holds all.
    outer, regions, lowest = [-1] * len(held), {}, 0
    for k, n in enumerate(held):
        outer[k] = outer[p.parents[k]] if outer[p.parents[k]] >= 0 else k if p.own[k] else -1
        if n and p.own[k] and n == held[outer[k]]:
            regions[outer[k]] = k
        if n and n == held[0]:
            lowest = k
    region, inside = set(regions.values()) or {lowest}, [False] * len(held)
    for k in range(len(held)):
        inside[k] = inside[p.parents[k]] or k in region
    return " ".join([t for t, _, _, k in lines if inside[k]])


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", *carried: str) -> DataFrame:
    """(key, carried columns, text) per input row."""
    cols = [key, *carried]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in cols) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([extract(h.as_py()) for h in b.column(len(cols))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], text], names=[*cols, "text"])

    return pages.select(*cols, F.col(html).alias("__html")).mapInArrow(run, schema)


def op3_html(spark, sf_dir):
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, "page_id", "html", "url").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
