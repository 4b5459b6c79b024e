"""Operator 5, HTML extraction: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's streaming parser turns a page into lines, one for each block of text,
each with its text-to-tag ratio (characters over tags). The logarithms of the ratios of *all*
lines, menus and footers too, are smoothed with a Gaussian and split where the two clusters'
squared distances are least (2-means in one dimension, solved exactly). Lines are then
gathered in segments, the lines of one container (article, section, div, list, table cell);
a segment belongs to the upper cluster if half of its characters do.

* On pages with article or main elements, the text is what stands in them, short lines too,
  but for segments that are mostly links and not in the upper cluster: lists of shares, tags
  or related pages, whatever they are called. Such a list stays if it lies between paragraphs of its article.
* On other pages it is the stretch from the first to the last line of the upper cluster in a
  segment of it, and the lines next to it in the same element, up to a list of links.

What the page itself says is no article (nav, footer, aside, form, roles, hidden) is left out
before that. A form, or what scripts have hidden from screen readers, is the page's frame and stays if an
article begins in it or it holds most of the page's text. Reader comments go by their names, articles among them too. Names in class or id leave an element out only if they name nothing else: each
word of the name must be a boilerplate word or a mere container word ("comment-list",
"ad-top"). A name with any other word ("related-work", "legal-analysis"), after a word like
"with" or "no", or on a heading or paragraph, says nothing, and the ratios decide. An
article inside an element that such names leave out, but for comments, counts if no other
article has a line of the upper cluster.

Cases: null html: empty text; pages without text: empty text; unclosed and misnested tags:
a block tag closes an open paragraph, an end tag closes up to its start tag or nothing;
a comment that is never closed is no text; repeated rows give repeated results; a long page is parsed in pieces. Empty tables give
empty results; columns named text or n_chars are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text a reader never sees as running text: they make no lines.
NOT_TEXT = frozenset("head title script style noscript template svg button input select textarea option iframe object canvas audio video map datalist".split())
#: Elements that are no part of an article; their lines still count for the clusters.
NOT_ARTICLE = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class or id that mark an element as no part of an article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification banner alert popup modal overlay newsletter subscribe subscription signup login comment comments respond reply replies responses disqus discussion "
    "share sharing social related recommended recommendations widget toolbar pagination pager search skip copyright legal disclaimer".split()
)
#: Those of them that mark what readers wrote.
COMMENTS = frozenset("comment comments respond responses reply replies disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say nothing about what a container holds.
CONTAINERS = frozenset(
    "area articles bar block body bottom box button buttons center col column container content count desktop feed field fixed form global group header icon icons inner item items large latest left "
    "link links list main meta middle mobile module more news outer page panel popular post posts primary products reader readers region right row secondary section site slot small sticky "
    "stories text thread title top topics unit user users wrap wrapper zone".split()
)
#: Words after which a hint only qualifies the element.
QUALIFIERS = frozenset("with without has have no non not".split())
#: Hints that are also names of an article's own sections.
SECTIONS = frozenset("discussion legal copyright disclaimer notice notices search social alert consent".split())
#: How class and id words see an element: as content, as left out, as an article inside what they leave out.
PLAIN, HINTED, INNER, COMMENT = range(4)
#: Blocks that hold text rather than other blocks.
TEXT_BLOCKS = HEADINGS | frozenset("p li dt dd pre caption figcaption summary legend address tr td th".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    tags: int
    region: int  # number of the enclosing article or main element, or 0
    seen: int  # PLAIN or INNER
    linked: int  # characters inside of links
    tag: str  # the innermost block element
    path: tuple[int, ...]  # the enclosing block elements, outermost first
    segment: int  # the innermost of them that holds other blocks, or 0
    out: bool  # the page says it is no part of an article
    frames: tuple[int, ...]  # the enclosing forms and hidden elements


_ROOT = ("", False, 0, PLAIN, False, 0, False, ())


class _Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, bool, int, bool, tuple[int, ...]]] = []  # tag, left out, region, seen, in a link, number, makes no lines, frames
        self.began: dict[int, tuple[int, ...]] = {}  # the frames around each region
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.regions = self.elements = self.linked = 0

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                around = [x for x in self.open if x[0] in BLOCK]
                _, out, region, seen, _, _, _, frames = self.open[-1] if self.open else _ROOT
                holder = next((x[5] for x in reversed(around) if x[0] not in TEXT_BLOCKS), 0)
                self.lines.append(Line(text, self.tags, region, seen, self.linked, around[-1][0] if around else "", tuple(x[5] for x in around), holder, out or seen in (HINTED, COMMENT), frames))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def _left_out(self, tag: str, attrs: list, region: int) -> bool:
        if tag in NOT_ARTICLE or tag == "header" and not region:
            return True
        for name, value in attrs if tag not in ("html", "body") else ():
            if name == "hidden":
                return True
            if not value:
                continue
            if name == "role" and value.lower() in ROLES or name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _hinted(self, tag: str, attrs: list, region: int) -> int:
        """HINTED, COMMENT or PLAIN; an article goes by the names of comments only."""
        if tag in ("html", "body", "main", "p") or tag in HEADINGS:
            return PLAIN
        for name, value in attrs:
            for one in (value or "").split() if name in ("class", "id") else ():
                words = [w.lower() for w in _TOKEN.findall(one)]
                hints = [w for w in words if w in HINTS and not (region and tag == "section" and w in SECTIONS) or w == "header" and not region]
                if hints and all(w in hints or w in CONTAINERS for w in words):
                    if not COMMENTS.isdisjoint(hints):
                        return COMMENT
                    if tag != "article":
                        return HINTED
        return PLAIN

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
            for i in range(len(self.open) - 1, -1, -1):  # a block closes an open paragraph
                if self.open[i][0] == "p":
                    del self.open[i:]
                    break
                if self.open[i][0] in BLOCK:
                    if self.open[i][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        del self.open[i:]
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, out, region, seen, linked, _, silent, frames = self.open[-1] if self.open else _ROOT
        self.elements += 1
        if tag == "form" or ("role", "form") in attrs or ("aria-hidden", "true") in attrs:
            frames = (*frames, self.elements)
        named = self._hinted(tag, attrs, region)
        if seen == COMMENT or named == COMMENT:
            seen = COMMENT
        elif tag in ("article", "main") or ("role", "main") in attrs:
            if not region or seen == HINTED:
                self.regions += 1
                region = self.regions
                self.began[region] = frames
            seen = INNER if seen == HINTED else seen
        elif named:
            seen = HINTED
        self.open.append((tag, out or self._left_out(tag, attrs, region), region, seen, linked or tag == "a", self.elements, silent or tag in NOT_TEXT, frames))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in BLOCK and tag not in BLOCK:
                return  # an inline end tag does not close a block

    def handle_data(self, data: str) -> None:
        if not self.open or not self.open[-1][6]:
            self.parts.append(data)
            if self.open and self.open[-1][4]:
                self.linked += len(data.strip())

    def done(self) -> list[Line]:
        """The lines. What stands in a frame is left out, unless an article begins there or most of the page's text is in it."""
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        self.close()
        self._flush()
        size: dict[int, int] = {}
        for x in self.lines:
            for f in x.frames if not x.out else ():
                size[f] = size.get(f, 0) + len(x.text)
        every = sum(len(x.text) for x in self.lines if not x.out)
        kept = {f for around in self.began.values() for f in around} | {f for f, n in size.items() if 2 * n > every}
        return [x._replace(out=True) if not kept.issuperset(x.frames) else x for x in self.lines]


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which logarithms are in the upper of the two clusters with the least squared distances; all, if they hardly differ."""
    x = np.sort(values)
    if len(x) < 3 or x[-1] - x[0] <= math.log(2):
        return np.ones(len(values), bool)
    n = np.arange(1, len(x))
    low = np.cumsum(x)[:-1]
    between = low**2 / n + (x.sum() - low) ** 2 / (len(x) - n)  # the more, the less is left within the clusters
    between[x[1:] == x[:-1]] = -np.inf  # equal values stay together
    return values >= x[int(np.argmax(between)) + 1]


def _upper(lines: list[Line]) -> np.ndarray:
    return upper_cluster(smoothed(np.log1p([len(x.text) / max(1, x.tags) for x in lines])))


def _links(lines: list[Line]) -> bool:
    """Whether over half of the characters are inside of links."""
    return 2 * sum(x.linked for x in lines) > sum(len(x.text) for x in lines)


def _stretch(lines: list[Line], content: np.ndarray) -> tuple[int, int]:
    """First and last line of the content and of what stands next to it in the same element."""
    own = content & np.array([not _links([x]) for x in lines])  # smoothing lifts links beside a long block
    first, last = np.flatnonzero(own if own.any() else content)[[0, -1]].tolist()
    around = {x.path[-2] for x, c in zip(lines, content) if c and len(x.path) > 1}
    text = lambda x: x.tag == "p" or x.tag in HEADINGS
    near = lambda x: (text(x) or not _links([x])) and (x.tag in HEADINGS or not around.isdisjoint(x.path))
    while first > 0 and near(lines[first - 1]):
        first -= 1
    while last + 1 < len(lines) and near(lines[last + 1]):
        last += 1
    return first, last


def _segments(lines: list[Line], content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, whether its segment is in the upper cluster, and whether it is that or not mostly links."""
    own: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        own.setdefault(x.segment, []).append(i)
    upper, fine = {}, {}
    for s, at in own.items():
        upper[s] = 2 * sum(len(lines[i].text) for i in at if content[i]) >= sum(len(lines[i].text) for i in at)
        fine[s] = upper[s] or not _links([lines[i] for i in at])
    return np.array([upper[x.segment] for x in lines]), np.array([fine[x.segment] for x in lines])


def _between(lines: list[Line], fine: np.ndarray) -> np.ndarray:
    """Which lines lie between paragraphs that stay, of their own region."""
    ends: dict[int, list[int]] = {}
    for i, (x, f) in enumerate(zip(lines, fine)):
        if f and x.tag == "p" and not _links([x]):
            ends.setdefault(x.region, [i, i])[1] = i
    return np.array([x.region in ends and ends[x.region][0] < i < ends[x.region][1] for i, x in enumerate(lines)])


def main_text(html: str, cluster=_upper) -> str:
    """The text of a page; cluster tells which of its lines are in the upper cluster."""
    parser = _Lines()
    for i in range(0, len(html), 1 << 16):
        parser.feed(html[i : i + (1 << 16)])
    every = parser.done()
    if not every:
        return ""
    both = [(x, bool(c)) for x, c in zip(every, cluster(every)) if not x.out]
    if any(x.seen == INNER for x, _ in both) and any(c and x.region and x.seen == PLAIN for x, c in both):
        both = [(x, c) for x, c in both if x.seen == PLAIN]
    if not both:
        return ""
    lines, content = [x for x, _ in both], np.array([c for _, c in both])
    inside = [i for i, x in enumerate(lines) if x.region]
    if inside:
        region = [lines[i] for i in inside]
        _, fine = _segments(region, content[inside])
        fine |= _between(region, fine)
        if not fine.any():
            most = max({x.region for x in region}, key=lambda r: sum(len(x.text) for x in region if x.region == r))
            fine = np.array([x.region == most for x in region])
        return "\n".join(x.text for x, f in zip(region, fine) if f)
    upper = content & _segments(lines, content)[0]  # smoothing lifts short lines beside long ones, but not their segment
    first, last = _stretch(lines, upper if upper.any() else content if content.any() else np.ones(len(lines), bool))
    return "\n".join(x.text for x in lines[first : last + 1])


def extracted(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars, in one pass without a shuffle."""
    return B.shielded(pages, ("html",), ("text", "n_chars"), _extracted)


def _extracted(pages: DataFrame) -> DataFrame:
    B.ready(pages.sparkSession)
    others = [f for f in pages.schema.fields if f.name != "html"]
    frame = pages.select(*[f.name for f in others], F.col("html").cast("string").alias("html"))

    def run(batches):
        for b in batches:
            text = [main_text(x) if x else "" for x in b.column("html").to_pylist()]
            b = b.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*b.schema.names, "text", "n_chars"])

    return frame.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
