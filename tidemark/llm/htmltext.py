"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math canvas object iframe audio video select textarea button datalist dialog".split())
FRAMES = frozenset("nav header footer aside form menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th ul".split())
#: Starting one of these ends an open paragraph; starting a list item or a cell ends an open one of its kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Words of a class, id or role that mark what isn't the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist contentinfo cookie cookies consent complementary copyright discussion disclaimer disqus dropdown footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications pagination pager popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar tooltip widget".split()
)
ARTICLE = frozenset("articlebody article-body article_body post-content entry-content article-content story-body".split())
#: Of these, words that also name parts of an article; as a part of a longer name they only count where the text is thin.
WEAK = frozenset("ad ads banner byline disclaimer footer form header notice notification promo promotion related search share skip social tags widget".split())
_TOKEN = re.compile(r"[a-z]+")
_QUIET = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Open(NamedTuple):
    """An open element, with the numbers of what it lies in, itself included; 0 where there is none."""

    tag: str
    number: int
    hidden: bool
    scope: int
    aside: int
    main: int


class Line(NamedTuple):
    """The text between two block boundaries, its characters in links, the tags met inside it, and where it lies."""

    text: str
    linked: int
    tags: int
    scope: int
    aside: int


class Lines(HTMLParser):
    """Turns parser events into lines. Unclosed and misplaced tags are forgiven: an end tag closes back to its start
    unless a container lies between. Every event takes a bounded time, apart from elements that it closes.

    An element's number is larger than those of the elements around it; ``outer`` has the next container, aside or main
    element around each of these, by kind.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [Open("", 0, False, 0, 0, 0)]
        self.at: dict[str, list[int]] = {}  # places in ``open`` by tag
        self.scopes = [0]  # places of containers
        self.outer: dict[str, dict[int, int]] = {"scope": {}, "aside": {}, "main": {}}
        self.weak: set[int] = set()  # asides whose mark is weak
        self.parts: list[str] = []
        self.tags = self.linked = self.number = 0
        self.ending = False

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inner = self.open[-1]
            self.lines.append(Line(text, self.linked, self.tags, inner.scope, inner.aside))
        self.parts, self.linked, self.tags = [], 0, 0

    def _pop(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()
            if self.scopes[-1] == len(self.open):
                self.scopes.pop()

    def _last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def _close(self, names: set[str]) -> None:
        """Close an open element of these names, unless a container lies between."""
        place = max(map(self._last, names))
        if place > 0 and place >= self.scopes[-1]:
            self._pop(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag not in ("option", "optgroup"):
                self._close({"p"})
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        values = {k: (v or "").lower() for k, v in attrs}
        names = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}".split()
        around, self.number = self.open[-1], self.number + 1
        n = self.number
        main = tag in ("article", "main") or values.get("role") == "main" or values.get("itemprop") == "articlebody" or not ARTICLE.isdisjoint(names)
        hidden = around.hidden or tag in HIDDEN or "hidden" in values or values.get("aria-hidden") == "true" or bool(_QUIET.search(values.get("style", "")))
        marks = ASIDE.intersection(part for name in names for part in _TOKEN.findall(name)) if tag not in ("html", "body") and not (main and tag == "main") else set()
        aside = tag in FRAMES or bool(marks)
        if aside and tag not in FRAMES and marks <= WEAK and marks.isdisjoint(names):
            self.weak.add(n)
        for kind, yes, outer in (("scope", tag in SCOPES, around.scope), ("aside", aside, around.aside), ("main", main, around.main)):
            if yes:
                self.outer[kind][n] = outer
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        if main and tag not in SCOPES:
            self.outer["scope"][n] = around.scope
        self.open.append(Open(tag, n, hidden, n if tag in SCOPES or main else around.scope, n if aside else around.aside, n if main else around.main))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        place = self._last(tag)
        if place > 0 and (tag in SCOPES or place >= self.scopes[-1]):
            self._pop(place)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections other than CDATA, which browsers take for comments, end at the next bracket; -1 waits for one."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _rest(self, end: int) -> int:
        """At the end of the page, markup that never closes takes all that is left, as in browsers."""
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_starttag(self, i: int) -> int:
        return self._rest(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._rest(super().parse_endtag(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._rest(super().parse_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        return self._rest(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._rest(super().parse_pi(i))

    def handle_data(self, data: str) -> None:
        if self.open[-1].hidden:
            return
        self.parts.append(data)
        if self.at.get("a"):
            self.linked += len(data)

    def close(self) -> None:
        self.ending = True
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with reflected ends, so that short pages aren't pulled to zero."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The midpoint between the means of two clusters, refined from the overall mean until it rests.

    Clusters whose means differ by less than a factor of 2 are one: then all values are above the threshold.
    """
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return float(values.min())
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut if high.mean() >= 2 * low.mean() else float(values.min())


def _content(lines: list[Line], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside links, and whether the smoothed text-to-tag ratio is in the upper cluster."""
    chars = np.array([len(x.text) - min(len(x.text), x.linked) for x in lines], float)
    flat = smoothed(chars / np.maximum(1, [x.tags for x in lines]), sigma)
    return chars, flat >= threshold(flat)


def _weights(at: list[int], chars: np.ndarray, outer: dict[int, int]) -> dict[int, float]:
    """Characters in each element, given those of each line and the element it lies in."""
    weight = dict.fromkeys(outer, 0.0)
    for element, c in zip(at, chars.tolist(), strict=True):
        if element:
            weight[element] += c
    for element in sorted(outer, reverse=True):  # the inner ones first
        if outer[element]:
            weight[outer[element]] += weight[element]
    return weight


def _kept_asides(page: Lines, sigma: float) -> set[int]:
    """Elements marked as aside that stay, as all marked ones around them do: those that hold nearly all (0.8) of the
    page's text in the upper cluster wrap the article, and those of a weak mark stay where most of their text is in it.
    """
    outer = page.outer["aside"]
    chars, content = _content(page.lines, sigma)
    at = [x.aside for x in page.lines]
    dense, all_chars = _weights(at, np.where(content, chars, 0.0), outer), _weights(at, np.array([len(x.text) for x in page.lines], float), outer)
    total, kept = float(chars[content].sum()), {0}
    for element in sorted(outer):  # the outer ones first
        wraps = dense[element] >= 0.8 * total > 0
        if outer[element] in kept and (wraps or (element in page.weak and dense[element] > 0.5 * all_chars[element])):
            kept.add(element)
    return kept


def _within(region: int, outer: dict[int, int]) -> set[int]:
    inside = {region}
    for element in sorted(outer):
        if outer[element] in inside:
            inside.add(element)
    return inside


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Blocks of the article, one per line; empty if there are none.

    Lines of menus, frames, forms, notices, adverts and comments are set aside by their elements, unless such an element
    holds nearly all of the page's text, or is only weakly marked and dense. The text-to-tag ratios of the others are
    smoothed and split in two clusters; the region is the article or main element with most text in the upper cluster,
    or, without such elements, the smallest one that holds nearly all of that text. All lines of the region stay, short
    ones too. Where no element holds the text, the lines from the first to the last of the upper cluster with
    text outside links are the region.
    """
    page = Lines()
    page.feed(html or "")
    page.close()
    if not page.lines:
        return ""
    kept = _kept_asides(page, sigma)
    lines = [x for x in page.lines if x.aside in kept]
    if not lines:
        return ""
    chars, content = _content(lines, sigma)
    scopes = page.outer["scope"]
    weight = _weights([x.scope for x in lines], np.where(content, chars, 0.0), scopes)
    held = {element for element, n in _weights([x.scope for x in lines], np.ones(len(lines)), scopes).items() if n}
    outer = {e: o for e, o in page.outer["main"].items() if e in held}
    if outer:
        region = max((e for e, o in outer.items() if o not in outer), key=lambda e: (weight[e], -e))
        for e in sorted(outer):
            if outer[e] == region and weight[e] >= 0.9 * weight[region] > 0:
                region = e
    else:
        total = float(chars[content].sum())
        region = max((e for e, w in weight.items() if w >= 0.9 * total > 0), default=0)
    if region:
        inside = _within(region, scopes)
        return "\n".join(x.text for x in lines if x.scope in inside)
    rows = np.flatnonzero(content & (chars > 0))
    return "\n".join(x.text for x in lines[rows[0] : rows[-1] + 1]) if len(rows) else ""


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``; one scan, rows on their own.

    A null or empty html has an empty text. Broken markup is read as far as it goes. Repeated rows come out alike; an
    empty table gives an empty result; other columns are left out.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
