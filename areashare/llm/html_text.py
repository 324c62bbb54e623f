"""Main text of web pages: parser events, text-to-tag ratios, and the region they point to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashare.llm.tokens import as_bytes

# HTML's own element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
REGIONS = frozenset("article main section div body td blockquote".split())
# Elements that are never main text, and those that are not outside an article. A form may be wrapped around
# a whole page, so its text decides; a button holds no blocks, so one that meets any was left open.
SKIPPED = frozenset(
    "script style noscript template title head nav footer aside button select textarea iframe object svg"
    " math canvas audio video dialog menu".split()
)
SKIPPED_OUTSIDE = frozenset(["header"])
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
NOT_IN_BUTTON = frozenset(
    "body article main section p h1 h2 h3 h4 h5 h6 header footer nav aside table blockquote".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
    " toolbar".split()
)
# A class or id of nothing but these words and plain ones names boilerplate. Beside other words they only make
# an element suspect, and its ratios decide. Words of comments need no ratio: readers write whole paragraphs.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar"
    " rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr"
    " notice notification alert popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended recommendations trending widget pagination pager skip".split()
)
NAMES_OUTSIDE = frozenset(["header"])
PLAIN = frozenset(
    "area articles bar block body bottom box button buttons column container content form global group icons"
    " inline inner item items left link links list main outer page panel posts primary right row secondary"
    " section site slot stories text title top unit wrap wrapper".split()
)
# A name that starts so speaks of what is around or missing.
ABOUT = frozenset("has no not with without".split())
NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

# Smoothing over neighbouring lines, and the part of the spread above which a line is content.
SIGMA = 1.0
SPREAD = 0.5
# An article of less than this part of the ratio of the largest one is a teaser.
TEASER = 1 / 3


@dataclass
class Line:
    """The text of one block, the tags met in it, and the innermost region and suspect element around it."""

    text: str
    tags: int
    region: int | None
    suspect: int | None


@dataclass
class Region:
    """An element that may hold the content: its kind, parent, outermost article and main element."""

    kind: str
    parent: int | None
    article: int | None
    main: int | None


@dataclass
class Suspect:
    """An element that is boilerplate unless its text says otherwise."""

    form: bool
    inside: bool  # an article or main element
    parent: int | None


@dataclass
class _Open:
    tag: str
    skipped: bool
    region: int | None  # this element's or the one around it
    suspect: int | None


@dataclass
class Page(HTMLParser):
    """Lines of a page as its parser events come in; skipped elements leave none.

    Regions and suspects are numbered as they open and know their parents, and what is asked of open elements is
    counted, so the time is linear in the page however deep it nests.
    """

    lines: list[Line] = field(default_factory=list)
    regions: list[Region] = field(default_factory=list)
    suspects: list[Suspect] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.blocks: list[int] = []  # places of open blocks in the stack
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.tags = 0
        self.skipping = 0

    def _around(self) -> tuple[int | None, int | None]:
        return (self.stack[-1].region, self.stack[-1].suspect) if self.stack else (None, None)

    def _close_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            self.lines.append(Line(text, self.tags, *self._around()))
        self.held, self.tags = [], 0

    def _inside(self) -> bool:
        return self.open["article"] + self.open["main"] > 0

    def _boilerplate(self, tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool]:
        """Whether an element is boilerplate, and whether it may be."""
        if tag in SKIPPED or (tag in SKIPPED_OUTSIDE and not self._inside()):
            return True, False
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True, False
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True, False
        if tag != "form" and (attrs.get("role") or "").lower() in ROLES:
            return True, False
        suspect = tag == "form"
        if tag in ("html", "body", "article", "main"):
            return False, False
        names = NAMES if self._inside() else NAMES | NAMES_OUTSIDE
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            parts = [part.lower() for part in NAME_PARTS.split(name) if part]
            if not parts or parts[0] in ABOUT or names.isdisjoint(parts):
                continue
            plain = all(part in names or part in PLAIN or part.isdigit() for part in parts)
            if plain or not COMMENTS.isdisjoint(parts):
                return True, False
            suspect = suspect or tag in BLOCKS
        return False, suspect

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            gone = self.stack.pop()
            self.open[gone.tag] -= 1
            self.skipping -= gone.skipped
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def _close_open(self, tag: str) -> None:
        """What a start tag closes by itself: the head, a paragraph, the item before, a button left open."""
        if self.open["head"] and tag not in IN_HEAD:
            self._pop_to(next(i for i, o in enumerate(self.stack) if o.tag == "head"))
        if self.open["button"] and tag in NOT_IN_BUTTON:
            for o in reversed(self.stack):
                if o.tag == "button" and o.skipped:
                    o.skipped = False
                    self.skipping -= 1
                    break
        if tag in BLOCKS:
            for kind in ("p", "li") if tag == "li" else ("p",):
                if self.blocks and self.stack[self.blocks[-1]].tag == kind:
                    self._pop_to(self.blocks[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close_line()
        self._close_open(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.skipping:
                self.held.append(" ")
            return
        skipped, doubted = self._boilerplate(tag, dict(attrs))
        region, suspect = self._around()
        if not skipped and not self.skipping:
            if tag in REGIONS:
                outer = self.regions[region] if region is not None else Region("", None, None, None)
                number = len(self.regions)
                article = number if outer.article is None and tag == "article" else outer.article
                main = number if outer.main is None and tag == "main" else outer.main
                self.regions.append(Region(tag, region, article, main))
                region = number
            if doubted:
                self.suspects.append(Suspect(tag == "form", self._inside(), suspect))
                suspect = len(self.suspects) - 1
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(_Open(tag, skipped, region, suspect))
        self.open[tag] += 1
        self.skipping += skipped

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # Outside of void elements HTML has no closed start tags; the element stays open.

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._close_line()
        self.tags += 1
        if self.open[tag]:
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag)
            if self.blocks and self.blocks[-1] >= at:
                self._close_line()
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.open["head"] and self.stack[-1].tag == "head" and data.strip():
            self._close_open("body")
        if not self.skipping:
            self.held.append(data)

    def finish(self) -> list[Line]:
        """The lines, without those in suspect elements that are boilerplate."""
        self.close()
        self._close_line()
        return cleared(self.lines, self.suspects)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends over what there is."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[radius : radius + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def content_lines(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose smoothed text-to-tag ratio is above a part of the ratios' spread, and those whose own is too."""
    ratio = np.array([len(line.text) / max(1, line.tags) for line in lines])
    smoothed = smooth(ratio)
    threshold = min(SPREAD * smoothed.std(), smoothed.max())
    return smoothed >= threshold, (smoothed >= threshold) & (ratio >= threshold)


def cleared(lines: list[Line], suspects: list[Suspect]) -> list[Line]:
    """The lines without those in suspect elements whose text does not speak for them.

    A form must hold most of the text that there is; another suspect, most of its own text in content lines,
    where neighbours count in an article only.
    """
    if not suspects or not lines:
        return lines
    chosen, own = content_lines(lines)
    held, good = np.zeros(len(suspects), int), np.zeros(len(suspects), int)
    for line, by_neighbours, by_itself in zip(lines, chosen, own):
        if line.suspect is not None:
            held[line.suspect] += len(line.text)
            inside = suspects[line.suspect].inside
            good[line.suspect] += len(line.text) * bool(by_neighbours if inside else by_itself)
    for number in range(len(suspects) - 1, -1, -1):
        parent = suspects[number].parent
        if parent is not None:
            held[parent] += held[number]
            good[parent] += good[number]
    total = sum(len(line.text) for line in lines)
    kept: list[bool] = []
    for number, suspect in enumerate(suspects):
        content = 2 * held[number] > total if suspect.form else 2 * good[number] > held[number]
        kept.append(content and (suspect.parent is None or kept[suspect.parent]))
    return [line for line in lines if line.suspect is None or kept[line.suspect]]


def main_lines(lines: list[Line], regions: list[Region]) -> list[Line]:
    """The lines of the region that holds the content.

    That are all outermost articles with content lines and a ratio not far below that of the largest one; without one,
    all such main elements; else the innermost region that holds all content lines but those raised by
    their neighbours alone. Short lines in it belong to it.
    """
    if not lines:
        return []
    chosen, own = content_lines(lines)
    for kind in ("article", "main"):
        outer = [None if line.region is None else getattr(regions[line.region], kind) for line in lines]
        text, tags = Counter(), Counter()
        for line, r in zip(lines, outer):
            text[r] += len(line.text)
            tags[r] += line.tags
        named = {r for r, good in zip(outer, chosen) if good and r is not None}
        if named:
            largest = max(named, key=lambda r: text[r])
            least = TEASER * text[largest] / max(1, tags[largest])
            named = {r for r in named if text[r] >= least * max(1, tags[r])}
            return [line for line, r in zip(lines, outer) if r in named]
    held = [line.region for line, good in zip(lines, own if own.any() else chosen) if good]
    # Content outside of any common region has the page for one.
    common = None if None in held else _common(min(held), max(held), regions)
    if common is None:
        return lines
    # Regions are numbered as they open: those inside come right after.
    last = common
    while last + 1 < len(regions) and _inside(regions[last + 1].parent, common):
        last += 1
    return [line for line in lines if line.region is not None and common <= line.region <= last]


def _inside(parent: int | None, region: int) -> bool:
    return parent is not None and parent >= region


def _common(a: int, b: int, regions: list[Region]) -> int | None:
    """The innermost region around two; around the first and last of several that is the one around all."""
    while a != b:
        if a < b:
            a, b = b, a
        if regions[a].parent is None:
            return None
        a = regions[a].parent
    return a


def main_text(html: str) -> str:
    """The main text of a page, one line per block."""
    page = Page()
    page.feed(html)
    return "\n".join(line.text for line in main_lines(page.finish(), page.regions))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.decode()) for html in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array(texts, pa.string()),
                pa.array([len(text) for text in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    A standard-library parser reads the page as a stream of events. Menus, notices and the like, known by
    element, role or whole name, leave no lines; each other block is a line. Text-to-tag ratios of lines are
    smoothed and cut at a threshold; they decide on forms and elements with a doubtful name, and the region
    that holds the lines above it is the content. A null, empty
    or textless page gives an empty text; unclosed elements end with the page. Repeated rows give the
    same text; other columns are not read. An empty table gives an empty one.
    """
    columns = [F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html"]
    return pages.select(*columns).mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint"
    )
