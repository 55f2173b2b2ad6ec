"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser feeds one pass over the page, which cuts
it into lines: a line ends where a block element begins or ends.  Each line has
its text, its tags, and where it stands (inside an article or main element, or
inside an element that never holds the article: navigation, page headers and
footers, sidebars, forms, scripts, notices, adverts, reader comments).  Lines of
the second kind go at once.  For the rest the ratio of characters to tags is
smoothed over neighbouring lines with a Gaussian, and a threshold that clusters
the ratios into two groups (the best split by variance between them) selects
content lines, on every page.  Content regions grow from these: the lines that
stand in the same section (the innermost div, section, article, main or body) as a
selected line stay with it if not mostly links, as short paragraphs and headings
do.  A mark is evidence: if a marked element holds a selected line, all its lines
stay, except those in marked elements inside of it that hold none (teasers).  A
heading directly above selected lines stays with them.

Defined cases: a null or empty page, or one without any text, gives the empty
string; unclosed and stray tags close at the next element that can't stand inside
them; a br is white space within its block; a repeated row is extracted again;
very long pages are one string at a time; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
BOILERPLATE = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas button select option textarea input label menu dialog datalist audio video map".split())
#: Elements that section a page.
SECTION = frozenset("article body div main section".split())
#: Headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role values that mark menus, notices, adverts and comments.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu\w*|breadcrumbs?|pagination|pager|sidebar\w*|widget\w*|footer\w*|toolbar|share|sharing|social|related|recommended|comments?|comment-\w+|disqus\w*|replies|reply|respond|login|search|skip|complementary|contentinfo|banner|navigation|dialog|hidden)(?:$|[\s_-])", re.I)
#: Words of class, id and role values that mark boilerplate outside of an article only.
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|side|hero)(?:$|[\s_-])", re.I)
#: Values of class, id and itemprop that mark the article itself.
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?(?:body|content)|entry-?content|main-?content|story-?body)(?:$|[\s_-])", re.I)
SIGMA = 1.0
#: A line with fewer characters a tag is no content, whatever its neighbours are.
LEAST = 2.0
#: Clusters of log ratios count as two if their means are so far apart.
APART = 0.7


class Line(NamedTuple):
    text: str
    tags: int
    marks: tuple[int, ...]  # the marked elements around it, outermost first
    heading: bool
    section: int  # the innermost element of SECTION around it
    linked: int  # characters within links, before white space is made one


class _Open(NamedTuple):
    tag: str
    bad: bool
    good: bool
    section: int  # the one around it


class _Lines(HTMLParser):
    """Cuts a page into lines; boilerplate elements leave none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.count: Counter[str] = Counter()  # open elements by name
        self.bad = self.marks = self.links = self.linked = self.section = self.sections = 0
        self.good: list[int] = []  # the marked elements that are open, outermost first
        self.text: list[str] = []
        self.tags = 0
        self.heading = False
        self.lines: list[Line] = []

    def close_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append(Line(text, self.tags, tuple(self.good), self.heading, self.section, self.linked))
            self.text.clear()
        self.tags, self.heading, self.linked = 0, False, 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCK:
            self.close_line()
            if tag in HEADINGS:
                self.heading = True
            if tag == "p":
                self._shut("p", BLOCK - {"p"})
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._shut(tag, frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        bad = tag in BOILERPLATE
        good = tag in ("article", "main")
        if tag == "header":  # of the page, not of an article's own title
            bad = not self.good
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "hidden") or name == "hidden":
                if name == "hidden" or name == "role" and value == "search" or tag not in ("html", "body", "article", "main") and (MARKED.search(value) or not self.good and OUTSIDE.search(value)):
                    bad = True
                elif ARTICLE.search(value) or name == "role" and value == "main":
                    good = True
        self.open.append(_Open(tag, bad, good, self.section))
        self.count[tag] += 1
        self.bad += bad
        self.links += tag == "a"
        if tag in SECTION:
            self.sections += 1
            self.section = self.sections
        if good:
            self.good.append(self.marks)
            self.marks += 1

    def _pop(self) -> None:
        last = self.open.pop()
        self.count[last.tag] -= 1
        self.bad -= last.bad
        self.links -= last.tag == "a"
        self.section = last.section
        if last.good:
            self.good.pop()

    def _shut(self, tag: str, up_to: frozenset[str]) -> None:
        """Ends an open element of this name that isn't outside of one in up_to."""
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].tag in up_to:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_line()
        self.tags += 1
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._pop()
                return

    def handle_data(self, data: str) -> None:
        if not self.bad:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def page_lines(html: str) -> list[Line]:
    """Each line with text outside boilerplate."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.close_line()
    return parser.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the weights that fall outside are left out."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[r : r + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The split of values into two clusters with the most variance between them: the larger cluster's smallest value."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return float(v[0]) if len(v) else 0.0
    n = np.arange(1, len(v))
    low = np.cumsum(v)[:-1] / n
    high = (v.sum() - np.cumsum(v)[:-1]) / (len(v) - n)
    between = n * (len(v) - n) * (high - low) ** 2
    between[v[1:] == v[:-1]] = -1
    return float(v[int(np.argmax(between)) + 1])


def main_text(html: str | None) -> str:
    lines = page_lines(html) if html else []
    if not lines:
        return ""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines], float)
    level = np.log1p(smoothed(ratio))
    keep = (level >= threshold(level)) & (ratio >= LEAST)
    if keep.all() or not keep.any() or level[keep].mean() - level[~keep].mean() < APART:
        keep[:] = True  # one cluster: nothing sets some lines apart
    holds = {m for x, k in zip(lines, keep) if k for m in x.marks}
    regions = {x.section for x, k in zip(lines, keep) if k}
    keep |= np.array([x.section in regions and 2 * x.linked <= len(x.text) for x in lines])
    keep |= np.array([bool(x.marks) and x.marks[-1] in holds for x in lines])
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= lines[i].heading and keep[i + 1]
    return "\n".join(x.text for x, k in zip(lines, keep) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            text = [main_text(html[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
