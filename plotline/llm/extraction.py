"""Main text of web pages by text-to-tag ratios.

A page is read as a stream of parser events, which cut its text into lines: what a block
element holds between two block boundaries. A line's ratio is its text outside links over
the tags in it. Ratios are smoothed by a Gaussian over neighbouring lines, so that a short
paragraph between long ones stays with them, and split into two clusters by a threshold
half-way between the clusters' means. Runs of lines above it are content regions; they show
which element of the page is the article, and that is returned but for its furniture.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import ship

#: Spread of the Gaussian, in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3
#: Clusters of smoothed ratios less than this apart, in logarithms, are one.
APART = math.log(8)
#: An article or main element is the article with this share of the regions' text; another
#: element takes the place of the one around it with the larger share.
ARTICLE_SHARE, OTHER_SHARE = 0.5, 0.8
#: So many lines of links one after another are a menu.
MENU_LINES = 3
#: Elements nested deeper count as part of the one at this depth, as in browsers.
DEPTH = 512
#: Between two blocks.
JOINT = "\n\n"

# fixed values: elements of HTML by what they mean for the text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td blockquote details fieldset".split())
FURNITURE = frozenset(
    "head title script style noscript template nav header footer aside form menu dialog search button select textarea datalist iframe object svg canvas audio video map".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
REMARKS = frozenset("comment comments commentlist commentary disqus respond replies reply discussion feedback".split())
MARKS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "header masthead footer toolbar related recommended recommendations share sharing social search login copyright disclaimer".split()
)
TEXTS = frozenset("article content entry main post story".split())
NEGATIONS = frozenset("has with no without".split())
#: Elements that an element of the same kind ends, and those within which it does not.
ENDED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_UNENDED = re.compile(r"<[!?/A-Za-z]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Mark:
    """An element whose text is no part of the article; ``firm`` ones stay so, others are
    lifted when an article is found in them."""

    firm: bool
    outer: Mark | None
    headings: bool = False  # its headings belong to the article
    lifted: bool = False

    def holds(self, heading: bool) -> bool:
        own = not self.lifted and not (heading and self.headings)
        return own or (self.outer is not None and self.outer.holds(heading))


@dataclass
class Line:
    text: str
    chars: int
    linked: int
    tags: int
    within: int  # number of the innermost container
    heading: str | None
    mark: Mark | None

    @property
    def dropped(self) -> bool:
        return self.mark is not None and self.mark.holds(self.heading is not None)

    @property
    def links(self) -> bool:
        return 2 * self.linked > self.chars


@dataclass
class Element:
    tag: str
    container: int
    mark: Mark | None
    heading: str | None
    link: bool
    #: Its own text is no part of the line around it; ``mute`` also silences blocks in it.
    silent: bool = False
    mute: bool = False


def _named(attrs: dict[str, str | None]) -> set[str]:
    """Parts of the element's class names and id; a name such as has-sidebar says nothing."""
    out: set[str] = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = {p.lower() for p in _NAME_PART.findall(name)}
        if not parts & NEGATIONS:
            out |= parts
    return out


@dataclass
class Page(HTMLParser):
    """Collects a page's lines, and the containers around them, from parser events."""

    lines: list[Line] = field(default_factory=list)
    #: Tag and enclosing container of each container; number 0 is the page.
    containers: list[tuple[str, int]] = field(default_factory=lambda: [("page", -1)])

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("page", 0, None, None, False)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.tags = 0

    def end_line(self) -> None:
        if self.parts and (text := " ".join("".join(self.parts).split())):
            top = self.stack[-1]
            self.lines.append(Line(text, len(text), self.linked, self.tags, top.container, top.heading, top.mark))
            self.tags = 0
        self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        for e in self.stack[to:]:
            self.open[e.tag] -= 1
        del self.stack[to:]

    def nearest(self, tags: Iterable[str], until: Iterable[str] = ()) -> int | None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in until:
                return None
        return None

    def close(self) -> None:
        if _UNENDED.match(self.rawdata):  # a comment or tag that never ends holds the rest
            self.rawdata = ""
        super().close()
        self.end_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            closes = [(("p",), ())] if self.open.get("p") else []
            closes += [(("head",), ())] if self.open.get("head") and tag not in ("html", "title") else []
            if tag in ENDED:
                closes.append((("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), ENDED[tag]))
            for names, until in closes:
                if (k := self.nearest(names, until)) is not None:
                    self.pop(k)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or len(self.stack) > DEPTH:
            return
        top = self.stack[-1]
        container = top.container
        if tag in CONTAINERS:
            self.containers.append((tag, container))
            container = len(self.containers) - 1
        heading = tag if tag in HEADINGS else top.heading
        mark = self.marked(tag, dict(attrs), top.mark)
        mute = top.mute or (tag in FURNITURE and tag not in BLOCKS)
        silent = mute or (tag not in BLOCKS and (top.silent or mark is not top.mark))
        self.stack.append(Element(tag, container, mark, heading, top.link or tag == "a", silent, mute))
        self.open[tag] = self.open.get(tag, 0) + 1

    def marked(self, tag: str, attrs: dict[str, str | None], outer: Mark | None) -> Mark | None:
        names = _named(attrs)
        if names & REMARKS:
            return Mark(True, outer)
        if tag in ("article", "main"):
            mark = outer
            while mark is not None and not mark.firm:
                mark.lifted, mark = True, mark.outer
            return outer
        own = bool(self.open.get("article") or self.open.get("main") or names & TEXTS)
        if tag in FURNITURE:
            return Mark(True, outer, headings=tag == "header" and own)
        if tag not in ("html", "body") and ((attrs.get("role") or "").lower() in ROLES or names & MARKS):
            return Mark(False, outer, headings="header" in names and own)
        return outer

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if self.open.get(tag):
            self.pop(self.nearest((tag,)))

    def handle_data(self, data: str) -> None:
        if self.stack[-1].silent:
            return
        self.parts.append(data)
        if self.stack[-1].link:
            self.linked += len("".join(data.split()))


def ratios(lines: list[Line]) -> np.ndarray:
    """Text outside links over tags; none for lines that are dropped anyway."""
    return np.array([0.0 if x.dropped else max(0, x.chars - x.linked) / max(1, x.tags) for x in lines])


def smoothed(values: np.ndarray) -> np.ndarray:
    """Mean of neighbouring values under a Gaussian, within the page."""
    weights = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    over = np.convolve(values, weights)[REACH : REACH + len(values)]
    return over / np.convolve(np.ones(len(values)), weights)[REACH : REACH + len(values)]


def threshold(values: np.ndarray, apart: float = 0.0) -> float:
    """The value half-way between the means of those below it and those from it on, found
    from the mean of all; where these means are not more than ``apart`` apart, all count
    as high."""
    cut = float(values.mean())
    for _ in range(100):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high) or high.mean() - low.mean() <= apart:
            return float(values.min())
        after = (float(low.mean()) + float(high.mean())) / 2
        if math.isclose(after, cut, rel_tol=1e-9):
            break
        cut = after
    return cut


def _article(page: Page, seeds: list[int]) -> int:
    """The container that holds the regions: from the page inwards, as long as one element
    has most of their text and leaves no title of the page outside."""
    lines, containers = page.lines, page.containers
    held, titles = [0] * len(containers), [0] * len(containers)
    for k in seeds:
        held[lines[k].within] += lines[k].chars
    for x in lines:
        titles[x.within] += x.heading == "h1" and not x.dropped
    inner: list[list[int]] = [[] for _ in containers]
    for c in range(len(containers) - 1, 0, -1):  # an element comes after the one around it
        up = containers[c][1]
        held[up] += held[c]
        titles[up] += titles[c]
        inner[up].append(c)
    at = 0
    while inner[at] and containers[at][0] != "article":
        most = max(inner[at], key=lambda c: held[c])
        named = containers[most][0] in ("article", "main")
        enough = held[most] >= (ARTICLE_SHARE if named else OTHER_SHARE) * held[at]
        if not held[most] or not enough or (not named and titles[most] < titles[at]):
            break
        at = most
    # an element that merely divides the article does not stand for it
    above = at
    while above and containers[above][0] != "article":
        above = containers[above][1]
    return above or at


def content(page: Page) -> list[Line]:
    """The lines of the page's article, in order."""
    lines = page.lines
    own = [k for k, x in enumerate(lines) if not x.dropped]
    if not own:
        return []
    score = np.log1p(smoothed(ratios(lines)))
    cut = threshold(score, APART)
    seeds = [k for k in own if score[k] >= cut and not lines[k].links] or own
    at = _article(page, seeds)
    inside = {at}
    for c in range(at + 1, len(page.containers)):
        if page.containers[c][1] in inside:
            inside.add(c)
    whole = page.containers[at][0] in ("article", "main")
    within = [k for k in own if lines[k].within in inside]
    if not whole:  # from the title, or the first region and the headings before it, to the last one
        found = [k for k in seeds if lines[k].within in inside]
        first = within.index(found[0])
        first = next((i for i in range(first, -1, -1) if lines[within[i]].heading == "h1"), first)
        while first and lines[within[first - 1]].heading:
            first -= 1
        within = [k for k in within[first:] if k <= found[-1]]
    menu = _menus(lines, within, score < cut, 1 if not whole else MENU_LINES)
    return [lines[k] for k in within if k not in menu]


def _menus(lines: list[Line], within: list[int], low: np.ndarray, least: int) -> set[int]:
    """Lines of links below the threshold, ``least`` or more one after another."""
    out: set[int] = set()
    run: list[int] = []
    for k in [*within, -1]:
        if k >= 0 and lines[k].links and low[k]:
            run.append(k)
            continue
        if len(run) >= least:
            out.update(run)
        run = []
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, an empty line between them."""
    page = Page()
    page.feed(html or "")
    page.close()
    return JOINT.join(x.text for x in content(page))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars.

    Character references are decoded, white space within a block is one space, and blocks
    come in page order, joined by two line feeds. Text is empty for a null or empty page and for one
    without text; n_chars counts code points. Repeated rows and null ids are returned
    each; pages of any length are read whole; an empty table gives an empty result;
    other columns are not read. Row by row: no shuffle.
    """
    ship(pages.sparkSession)
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"_id {id_type}, _url {url_type}, text string, n_chars bigint").withColumnsRenamed({"_id": id_col, "_url": url_col})
