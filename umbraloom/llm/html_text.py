"""Main text of web pages from the events of the standard library's HTML parser.

Each block becomes a line with its text-to-tag ratio. Ratios are smoothed with a Gaussian, lines above a threshold form
clusters, and the clusters say which region of the page is content: the article or main element that holds most of
their text with what is nested in it, with others beside it that hold at least a third as much, and with a title and lead right before it; else the
stretch from the first cluster to the last with the headings and short blocks next to it. Menus, adverts and the like are no lines at all. All lines of the chosen
region are kept, short ones too. A form, and an element that only its class, id or role marks as an advert or the like, counts as content where it holds the page.
Time is in proportion to the page: which elements are around a line is a tree, whose sums are taken once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0  # lines
THRESHOLD = 0.5  # of the mean smoothed ratio
BESIDE = 3  # a region beside the best one counts if so many times its text is as much
#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose text is never content. A header counts outside of an article only.
NEVER = frozenset("aside audio button canvas dialog embed footer head iframe input map menu nav noscript object option script select style svg template textarea title video".split())
#: Elements that are marked by their name alone: a page may stand in one.
MARKED = frozenset(("fieldset", "form"))
#: As NEVER, as words of a class, id or role.
NEVER_WORDS = frozenset("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words beside which they still mark, as in comment-list; beside others, as in social-science, they do not.
LAYOUT = frozenset("area article articles bar block body bottom box btn button buttons card cards container content dialog entry feed fixed float form global group header heading holder icons inner item items label layer layout left left2 link links list main message middle mobile module outer overlay page panel part post posts right row section signup site slot small sticky story stories text thread title top unit view wrap wrapper".split())
#: Words of a class or id that tell readers' comments even on an article.
REPLIES = frozenset("comment comments disqus replies reply".split())
#: A name that starts with one of these, such as has-sidebar, tells what is around and marks nothing.
MODIFIERS = frozenset("has have no not with without".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end where the next of the listed ones starts.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SEPARATOR = re.compile(r"[^a-z0-9]+")


@dataclass
class Line:
    text: str
    tags: int
    region: int  # number of the innermost article or main element around it, 0 for none
    mark: int  # number of the innermost marked element around it, 0 for none
    heading: str  # name of the heading it stands in, or empty
    linked: int  # characters in links


class Element(NamedTuple):
    name: str
    never: bool  # whether its text is never content
    region: int
    mark: int
    heading: str
    link: bool


@dataclass
class Mark:
    whole: bool  # whether a word of NEVER_WORDS is a whole name, not a part of one
    region: int  # the innermost article or main around it, 0 for none
    parent: int  # the innermost marked element around it
    depth: int


@dataclass
class Region:
    parent: int
    mark: int  # the innermost marked element around it


ROOT = Element("", False, 0, 0, "", False)


class Lines(HTMLParser):
    """Collects the lines of a page that can be content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Element] = []
        self.names: dict[str, int] = defaultdict(int)  # open elements of each name
        self.parts: list[str] = []
        self.marks = [Mark(False, 0, 0, 0)]  # the first stands for none, as in regions
        self.regions = [Region(0, 0)]
        self.tags = self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1] if self.open else ROOT
            self.lines.append(Line(text, self.tags, at.region, at.mark, at.heading, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
            self.close_implied(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, never, region, mark, heading, link = self.open[-1] if self.open else ROOT
        if not never:
            names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()]
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)
            never = tag in NEVER or tag == "header" and not region or hidden
            marked = tag in MARKED or names and tag not in ("body", "html") and any(map(_marked if tag not in CONTENT else _marked_region, names))
            if tag in CONTENT and not never and not marked:
                self.regions.append(Region(region, mark))
                region = len(self.regions) - 1
            if not never and marked:
                self.flush()
                self.marks.append(Mark(tag in MARKED or not NEVER_WORDS.isdisjoint(names), region, mark, self.marks[mark].depth + 1))
                mark = len(self.marks) - 1
            if never:
                self.flush()
        self.open.append(Element(tag, never, region, mark, tag if tag in HEADINGS else heading, link or tag == "a"))
        self.names[tag] += 1

    def close(self) -> None:
        super().close()
        self.flush()

    def cut(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for e in self.open[at:]:
            self.names[e.name] -= 1
        del self.open[at:]

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, with what is open in it; list items and cells end those before them."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].name
            if name == "p" or tag in CLOSED_BY.get(name, ()):
                self.cut(k)
                return
            if name not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].name == tag), None) if self.names[tag] else None
        if tag not in INLINE or at is not None and (self.open[at].never or self.open[-1].mark != (self.open[at - 1] if at else ROOT).mark):
            self.flush()
        if at is not None:
            self.cut(at)

    def handle_data(self, data: str) -> None:
        at = self.open[-1] if self.open else ROOT
        if not at.never:
            self.parts.append(data)
            if at.link:
                self.linked += len(data.strip())

    def within_regions(self, sizes: list[float]) -> list[float]:
        """For each region the sum of its own lines' sizes and of those nested in it."""
        out = [0.0] * len(self.regions)
        for x, n in zip(self.lines, sizes, strict=True):
            out[x.region] += n
        for r in range(len(out) - 1, 0, -1):  # inner ones have higher numbers
            if self.regions[r].parent:
                out[self.regions[r].parent] += out[r]
        return out

    def within_marks(self, sizes: list[float]) -> list[float]:
        out = [0.0] * len(self.marks)
        for x, n in zip(self.lines, sizes, strict=True):
            out[x.mark] += n
        for m in range(len(out) - 1, 0, -1):
            if self.marks[m].parent:
                out[self.marks[m].parent] += out[m]
        return out

    def blocked(self, out: set[int]) -> list[bool]:
        """For each mark whether it or one around it is out."""
        got = [False] * len(self.marks)
        for m in range(1, len(got)):
            got[m] = m in out or got[self.marks[m].parent]
        return got

    def content(self) -> list[Line]:
        """The lines outside of marked elements, but for those that turn out to hold the page or most of a region."""
        marks, regions, out = self.marks, self.regions, set(range(1, len(self.marks)))
        if out:
            sizes = [len(x.text) for x in self.lines]
            of_mark, of_region, total = self.within_marks(sizes), self.within_regions(sizes), sum(sizes)
            used = [r for r in range(1, len(regions)) if of_region[r]]
            inner = [0.0] * len(marks)  # the most that a region inside a mark holds
            for r in used:
                inner[regions[r].mark] = max(inner[regions[r].mark], of_region[r])
            for m in range(len(marks) - 1, 0, -1):
                inner[marks[m].parent] = max(inner[marks[m].parent], inner[m])
            if used:  # what is around all regions, as deep as around the one with least around it, are wrappers
                depth = min(marks[regions[r].mark].depth for r in used)
                out -= {m for m in out if marks[m].depth <= depth and inner[m]}
            rest = None  # sums without the lines of whole marks that are out
            for m in range(1, len(marks)):  # outer ones first
                mark = marks[m]
                if not mark.region:
                    keep = 2 * of_mark[m] > total and not used or 2 * inner[m] > total
                elif mark.whole:
                    keep = 2 * of_mark[m] > of_region[mark.region] and inner[m] > 0 and not self.free_inside(mark.region, used, out)
                else:
                    if rest is None:
                        whole = self.blocked({k for k in out if marks[k].whole})
                        left = [0 if whole[x.mark] else n for x, n in zip(self.lines, sizes, strict=True)]
                        rest = self.within_marks(left), self.within_regions(left)
                    keep = 2 * rest[0][m] > rest[1][mark.region]
                if keep and m in out:
                    out.discard(m)
                    rest = None if mark.whole else rest
        kept, tags, gone = [], 0, self.blocked(out)
        for x in self.lines:
            if gone[x.mark]:
                tags += x.tags
            else:
                x.tags += tags
                tags = 0
                kept.append(x)
        return kept

    def free_inside(self, region: int, used: list[int], out: set[int]) -> bool:
        """Whether a region nested in another stands in no mark that is out."""
        gone, nested = self.blocked(out), [False] * len(self.regions)
        for r in range(region + 1, len(self.regions)):
            nested[r] = self.regions[r].parent == region or nested[self.regions[r].parent]
        return any(nested[r] and not gone[self.regions[r].mark] for r in used)


def _marked(name: str) -> bool:
    words = [w for w in SEPARATOR.split(name) if w]
    return bool(words) and words[0] not in MODIFIERS and not NEVER_WORDS.isdisjoint(words) and all(w in NEVER_WORDS or w in LAYOUT or w.isdigit() or len(w) < 3 for w in words)


def _marked_region(name: str) -> bool:
    """An article or main element is taken at its word: only a whole name, or readers' comments, mark it."""
    return name in NEVER_WORDS or _marked(name) and not REPLIES.isdisjoint(SEPARATOR.split(name))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, mode="valid")


def main_text(html: str | None) -> str:
    """The page's content lines, joined by line feeds."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines = parser.content()
    if not lines:
        return ""
    score = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    content = score >= THRESHOLD * score.mean()
    weight = parser.within_regions([len(x.text) * (1 + bool(c)) for x, c in zip(lines, content, strict=True)])
    weight[0] = 0.0
    if any(weight):
        best = max(range(len(weight)), key=lambda r: (weight[r], -r))
        chosen = [False] * len(weight)
        for r in range(1, len(weight)):
            chosen[r] = r == best or chosen[parser.regions[r].parent] or not parser.regions[r].parent and BESIDE * weight[r] >= weight[best]
        inside = [chosen[x.region] for x in lines]
        first = inside.index(True)
        before = _title(lines, first) if not any(x.heading == "h1" for x, i in zip(lines, inside, strict=True) if i) else first
        return "\n".join(x.text for k, (x, i) in enumerate(zip(lines, inside, strict=True)) if i or before <= k < first)
    at = np.flatnonzero(content)
    return "\n".join(x.text for x in lines[_start(lines, at[0]) : _end(lines, at[-1])])


def _title(lines: list[Line], first: int) -> int:
    """Where the title right before a region is, with nothing but blocks of text between; the region's own start if there is none."""
    k = first - 1
    while k >= 0 and not lines[k].region and not _boilerplate(lines[k]):
        if lines[k].heading == "h1":
            return k
        k -= 1
    return first


def _boilerplate(x: Line) -> bool:
    return not x.heading and (2 * x.linked > len(x.text) or x.text.lower().startswith(("\u00a9", "copyright", "all rights reserved")))


def _start(lines: list[Line], i: int) -> int:
    """The first line of the content around line i: back to the page's title, or to where links are. One line of links below a heading is a byline."""
    while i > 0 and lines[i].heading != "h1" and (not _boilerplate(lines[i - 1]) or i > 1 and lines[i - 2].heading):
        i -= 1
    return i


def _end(lines: list[Line], i: int) -> int:
    i += 1
    while i < len(lines) and not _boilerplate(lines[i]):
        i += 1
    return i


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, one for one.

    Null or empty html, and pages without content, have an empty text. Null page_id and url are passed on.
    Repeated rows get a row each; an empty table gives none. Pages of any length are read whole. Other columns are not read.
    """
    ids = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
