"""Main text of web pages, from text-to-tag ratios.

The standard library's parser streams a page's events into lines, one per block
element. A line's ratio is its characters over its tags. The ratios are smoothed
with a Gaussian. Lines at or above one standard deviation are content, where a
ratio counts for at most twice the median, so that a long line doesn't hide the
others. The container around all content is taken as a whole, so that short lines
are not lost; outside articles its lists of links are left out. Where articles
(article, main) hold half of the text or of the content, all else is none. Lines
in menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and hidden parts are no content, whatever their ratio, nor are articles in them
or with such a name, see ``_able``. The end of an article or of a container ends
what was left open in it.

Character references are decoded, white space inside a block becomes one space,
lines are trimmed, empty ones left out, and joined in page order by a newline.
No string makes the parser fail: unknown declarations are comments.

Defined cases: null or empty html, or a page without content: an empty text. Ids
and urls may be null or repeated: each row is judged alone. An empty table stays
empty. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import small_batches

# fixed values: names of elements, and of classes, ids and roles
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article main".split())
WEAK_CONTAINERS = frozenset("div section td body".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea script style noscript template svg iframe dialog menu title object canvas header".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:s|tion)?|nav(?:bar|igation)?|menu|side-?bar|footer|header|masthead|breadcrumbs?|comments?|comment-?list|disqus|cookies?|consent|gdpr|notice|banner|pop-?up|modal|share|social|newsletter|subscribe|related|widget|skip-?link)(?:$|[-_\s])",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SIGMA = 1.0


SOFT, HARD, UNSEEN = 1, 2, 3  # boilerplate by name or a form, by its element or role, or not shown at all


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int  # characters in links
    box: int  # the container
    strong: bool  # an article or main is around it
    top: int  # the outermost article or main, or that inside ``held``
    skipped: bool
    held: int  # boilerplate with an article in it that this line is in


@dataclass(slots=True)
class Held:
    """Boilerplate with an article in it; only its end tag tells if the article is part of it."""

    tag: str
    depth: int
    number: int
    containers: int
    named: bool  # an article that is boilerplate by its own name


class Lines(HTMLParser):
    """The lines of a page, its containers and the boilerplate around articles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.tags = self.links = self.anchors = 0
        self.open: list[tuple[str, int, int, int]] = []  # containers: tag, number, nearest strong one, top
        self.parent, self.last = [0], [0]  # of containers, by number: the one around it, the last one in it
        self.skip = ""  # the element of boilerplate that is open, how deep and of what level
        self.depth = self.level = 0
        self.held: list[Held] = []
        self.levels = [0]  # by number of held boilerplate
        self.closed: set[int] = set()

    def close(self) -> None:
        super().close()
        self.flush()
        self.closed.update(h.number for h in self.held if h.named)
        self._leave(0)
        self.last[0] = len(self.last) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text or self.tags:
            _, box, strong, top = self.open[-1] if self.open else ("", 0, 0, 0)
            self.lines.append(Line(text, self.tags, self.links, strong or box, bool(strong), top, bool(self.skip), self.held[-1].number if self.held else 0))
        self.words, self.tags, self.links = [], 0, 0

    def _enter(self, tag: str) -> None:
        number = len(self.last)
        around = self.open[-1] if self.open else ("", 0, 0, 0)
        inner = len(self.open) > (self.held[-1].containers if self.held else 0)
        strong = number if tag in CONTAINERS else around[2]
        self.parent.append(around[1])
        self.last.append(number)
        self.open.append((tag, number, strong, inner and around[3] or (number if tag in CONTAINERS else 0)))

    def _leave(self, kept: int) -> None:
        for _, number, *_ in self.open[kept:]:
            self.last[number] = len(self.last) - 1
        del self.open[kept:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br" or tag == "td":
            self.words.append(" ")
        if tag in VOID:
            return
        self.anchors += tag == "a"
        for h in self.held:
            h.depth += tag == h.tag
        if self.skip and tag in CONTAINERS and self.skip not in ("template", "noscript", "svg"):
            if self.skip != "p":  # an article ends a paragraph
                self._hold(self.skip, self.depth, self.level, False)
            self.skip = ""
        if self.skip:
            self.depth += tag == self.skip
        elif level := self._boilerplate(tag, attrs):
            if tag == "article" and level < UNSEEN:  # kept apart, as the name may mislead
                self._hold(tag, 1, level, True)
                self._enter(tag)
                return
            self.flush()
            self.skip, self.depth, self.level = tag, 1, level
        elif tag in CONTAINERS or tag in WEAK_CONTAINERS:
            self._enter(tag)

    def _hold(self, tag: str, depth: int, level: int, named: bool) -> None:
        self.levels.append(max(level, self.levels[self.held[-1].number] if self.held else 0))
        self.held.append(Held(tag, depth, len(self.levels) - 1, len(self.open), named))

    def _boilerplate(self, tag, attrs) -> int:
        inside = bool(self.open and self.open[-1][2])
        level = 0
        if tag in BOILERPLATE and not (tag == "header" and inside):
            level = SOFT if tag == "form" else HARD
        if tag in ("html", "body", "main"):
            return 0
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                return UNSEEN
            if name == "role" and value.lower() in ROLES:
                level = max(level, SOFT if tag == "form" else HARD)
            if name in ("class", "id") and NAMES.search(value) and not (tag[0] == "h" and tag[1:].isdigit()):
                level = max(level, SOFT)
        return level

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self.anchors -= tag == "a" and self.anchors > 0
        for k, h in enumerate(self.held):
            h.depth -= tag == h.tag
            if not h.depth:
                self.flush()
                self.closed.update(x.number for x in self.held[k:])
                self._leave(h.containers)
                del self.held[k:]
                self.skip = ""
                return
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.flush()
                    self.skip = ""
                return
            if tag in ("body", "html"):
                self.skip = ""
            elif tag in CONTAINERS and any(x[0] == tag for x in self.open):  # ends all that is open in it
                self.skip = ""
            else:
                return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while tag != "body" and self.held and self.held[-1].containers > i:
                    self.closed.add(self.held.pop().number)
                self._leave(i)
                break

    def parse_marked_section(self, i, report=1):
        """<![...]> is no markup of web pages: a comment up to the next >."""
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        self.words.append(data)
        if self.anchors:
            self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _able(parser: Lines) -> np.ndarray:
    """The lines that are no boilerplate.

    An article in boilerplate that was never closed is content, in closed one it
    isn't, unless it alone has most of the page's text and the boilerplate was
    told by a name (a wrapper called "no-sidebar"), or the page has no other text.
    """
    lines = parser.lines
    shown = np.array([bool(x.text) and not x.skipped for x in lines])
    inner = np.array([x.held in parser.closed for x in lines])
    able = shown & ~inner
    level = [parser.levels[x.held] for x in lines]
    sizes: dict[tuple[int, int], int] = {}
    for x, l, ok in zip(lines, level, (shown & inner).tolist()):
        if ok and x.top and l < UNSEEN:
            sizes[x.top, l] = sizes.get((x.top, l), 0) + len(x.text)
    if sizes:
        best = max(sizes, key=sizes.get)
        outside = sum(len(x.text) for x, ok in zip(lines, able.tolist()) if ok)
        if not outside or best[1] == SOFT and 2 * sizes[best] > outside + sum(sizes.values()):
            able |= shown & inner & np.array([(x.top, l) == best for x, l in zip(lines, level)])
    return able


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    able = _able(parser)
    if not able.any():
        return ""
    size = np.array([len(x.text) for x in lines])
    tags = np.array([max(x.tags, 1) for x in lines])
    listed = 2 * np.array([x.links for x in lines]) > size
    strong = np.array([x.strong for x in lines])
    box = np.array([x.box for x in lines])
    ratio = size / tags
    height = smoothed(ratio)
    # a few long lines shall not lift the bar over all others
    plain = able & ~listed
    bar = smoothed(np.minimum(ratio, 2 * np.median(ratio[plain]))).std() if plain.any() else height.std()
    content = able & (height >= min(bar, height.std()))
    if not content.any():
        content = able & (height >= height[able].max())
    if any(2 * size[of & strong].sum() >= size[of].sum() for of in (able, content)):  # what lies outside an article is none
        able &= strong
        if not (content & able).any():
            content = able & (height >= height[able].max()) if able.any() else content
        content &= able
    # the container around all content, whole but for lists of links outside articles
    low, high = int(box[content].min()), int(box[content].max())
    around = low
    while parser.last[around] < high:
        around = parser.parent[around]
    text, links = np.bincount(box[able], size[able]), np.bincount(box[able], size[able] * listed[able])
    lists = np.flatnonzero(2 * links > text)
    kept = able & (box >= around) & (box <= parser.last[around])
    kept &= strong | ~np.isin(box, lists) | np.isin(box, box[content])
    return "\n".join(x.text for x, ok in zip(lines, kept.tolist()) if ok)


def _extract(batches):
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
