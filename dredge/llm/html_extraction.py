"""Main text of web pages by text-to-tag ratios, from standard-library parser events.

One streaming pass over the parser's events cuts a page into lines, one per block of text, each with its
number of characters, of tags and of characters in links, and the element it stands in. The ratio of
text to tags of each line is smoothed with a Gaussian along the page and split at the threshold between
its two clusters; the lines over it are rich. Elements that are not the article by name (menus, headers,
footers, asides, forms, adverts, notices, comments, by tag, role, class or id) are a hint: their lines
count as without text.

The region is chosen by the rich lines: from the root the way goes to the element that holds most of the
rich text, as long as it holds SHARE of it, and ends at the last element that can contain an article, an
article or main element if it passed one. All lines of the region are the text, in page order, short ones
too, but for those of elements named apart and poor lines made of links. Where no element below the body
holds the article, the region is the span of the rich lines, widened by neighbours of the same parent
that read like text; headings right before the region belong to it.

Character references are decoded; white space within a block becomes one space. Null and empty pages
have empty text. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose start ends a block, elements that are never text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
APART = frozenset(
    "nav footer aside form script style noscript template iframe object svg math canvas audio video button select "
    "textarea menu dialog title head".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu sidebar footer masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice popup modal "
    "overlay subscribe subscription newsletter signup social share sharing related recommended comments comment disqus "
    "respond reply replies widget toolbar skip".split()
)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _named_apart(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = [x.lower() for x in _PARTS.findall(name)]
                if parts and (parts[0] in NAMES or parts[-1] in NAMES):
                    return True
    return False


#: Elements that hold an article, and elements that hold a piece of running text.
HOLDERS = frozenset("article main section div td center body html".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Part of the rich text that an element must hold to be followed.
SHARE = 0.6


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    element: int
    apart: bool


class _Lines(HTMLParser):
    """Collects lines and the elements they stand in; parents come before their children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Tag and parent of each element; 0 is the page.
        self.tag_of, self.parent = ["html"], [0]
        #: Open elements: (tag, set apart, number, number of the nearest block).
        self.open: list[tuple[str, bool, int, int]] = []
        self.apart = self.article = self.links = 0
        self.lines: list[Line] = []
        self.held: list[str] = []
        self.tags = self.linked = 0
        self.place: tuple[int, bool] | None = None

    def _end_line(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text and self.place is not None:
                self.lines.append(Line(text, max(1, self.tags), self.linked, *self.place))
                self.tags = 0
            self.held, self.linked, self.place = [], 0, None

    def _pop(self) -> None:
        tag, apart, _, _ = self.open.pop()
        self.apart -= apart
        self.article -= tag in ("article", "main")
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end_line()
            # An open paragraph ends where a block begins.
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    while len(self.open) > i:
                        self._pop()
                    break
                if self.open[i][0] in BLOCK:
                    break
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        apart = tag in APART or (tag == "header" and not self.article) or (tag not in ("html", "body") and _named_apart(attrs))
        if tag == "body" and self.open:
            # The body begins whatever was left open before it.
            while self.open:
                self._pop()
        number = len(self.parent)
        self.parent.append(self.open[-1][2] if self.open else 0)
        self.tag_of.append(tag)
        self.open.append((tag, apart, number, number if tag in BLOCK or not self.open else self.open[-1][3]))
        self.apart += apart
        self.article += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                break
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style", "template", "noscript"):
            return
        if data.strip():
            self.linked += len(data) if self.links else 0
            if self.place is None:
                self.place = (self.open[-1][3] if self.open else 0, self.apart > 0)
        self.held.append(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def parse(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the edges the weights that fall outside are left out."""
    reach = int(np.ceil(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    top = np.convolve(ratio, weight, "full")[reach : reach + len(ratio)]
    return top / np.convolve(np.ones(len(ratio)), weight, "full")[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """Middle between the means of two clusters (Lloyd's iteration from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(under) or not len(over):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def rich_lines(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, float]:
    """Which lines are over the threshold, the smoothed ratios, and the threshold."""
    ratio = smooth(np.array([0.0 if x.apart else len(x.text) / x.tags for x in lines]))
    cut = threshold(ratio)
    rich = (ratio >= cut) & ~np.array([x.apart for x in lines])
    return rich, ratio, cut


def container(page: _Lines, rich: np.ndarray) -> int:
    """Number of the element that holds the article; 0 where only the page does."""
    mass = np.zeros(len(page.parent))
    for x, r in zip(page.lines, rich, strict=True):
        mass[x.element] += len(x.text) * r
    own = mass.tolist()
    heaviest = [0] * len(own)
    for i in range(len(own) - 1, 0, -1):
        up = page.parent[i]
        own[up] += own[i]
        if not heaviest[up] or own[i] >= own[heaviest[up]]:
            heaviest[up] = i
    at, best, named = 0, 0, 0
    while heaviest[at] and own[heaviest[at]] >= SHARE * own[0] > 0:
        at = heaviest[at]
        tag = page.tag_of[at]
        if tag in ("article", "main"):
            named = at
        if tag in HOLDERS:
            best = 0 if tag in ("html", "body") else at
    return named or best


def _inside(page: _Lines, element: int) -> np.ndarray:
    """Which lines stand in the element."""
    within = [False] * len(page.parent)
    for i in range(len(within)):
        within[i] = i == element or (i > 0 and within[page.parent[i]])
    return np.array([within[x.element] for x in page.lines])


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines."""
    page = parse(html) if html else None
    lines = page.lines if page else []
    if all(x.apart for x in lines):
        return ""
    rich, ratio, cut = rich_lines(lines)
    if not rich.any():
        # Everything over the threshold is set apart: judge the rest alone.
        left = np.array([not x.apart for x in lines])
        rich = left & (ratio >= threshold(ratio[left]))
    linky = np.array([2 * x.linked > len(x.text) for x in lines])
    element = container(page, rich)
    if element:
        chosen = _inside(page, element)
    else:
        found = np.flatnonzero(rich)
        first, last = int(found[0]), int(found[-1])
        parent = lambda i: page.parent[lines[i].element]

        def reads(i: int, beside: int) -> bool:
            if not 0 <= i < len(lines) or lines[i].apart or linky[i] or parent(i) != parent(beside):
                return False
            return page.tag_of[lines[i].element] in TEXTUAL or ratio[i] >= cut / 2

        while reads(first - 1, first):
            first -= 1
        while reads(last + 1, last):
            last += 1
        chosen = np.zeros(len(lines), bool)
        chosen[first : last + 1] = True
    start = int(np.flatnonzero(chosen)[0])
    while start and page.tag_of[lines[start - 1].element] in HEADINGS and not lines[start - 1].apart and not linky[start - 1]:
        start -= 1
        chosen[start] = True
    return "\n".join(x.text for x, c, r, link in zip(lines, chosen, rich, linky, strict=True) if c and not x.apart and (r or not link))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
