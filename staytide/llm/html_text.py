"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams a page's events. Text gathers in blocks, the lines of the method; a block
ends where a block-level tag begins or ends. Each block has a ratio of text to tags. The ratios are smoothed with a
Gaussian along the page and split by the threshold that separates them best; blocks above it mark
the regions of the page that hold the content: the outermost article or main element, else the container next
to the block. All blocks of those regions are the text, so that a short paragraph between long ones stays. Article
and main elements come before other regions if one of their blocks is above the threshold.

What is not article by its tag (navigation, forms, scripts, and the like), is left out with all it holds. An element whose class, id or
role has a word for such parts (advert, sidebar, comments, cookie notice, ...) is left out too, unless it holds most of the page's text of
high ratio; one that is named by such a word alone must hold all of it. Article and main elements are never left out by name.

Defined results: NULL and empty pages, and pages without text, give an empty text; text outside any tag is a block of the body;
unclosed tags end with what holds them. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staytide.llm.textarrays import column

# Element names of HTML, by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template svg math canvas object iframe audio video nav footer aside form button select "
    "textarea fieldset label menu dialog datalist map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption td th".split()
)
REGIONS = frozenset(["article", "main"])
CONTAINERS = frozenset(["article", "main", "section", "div", "body", "td"])
# Words of class, id or role that say an element is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar side aside widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs topbar "
    "header masthead footer bottom copyright comment comments commentlist disqus reply replies respond related recommended share sharing "
    "social newsletter subscribe subscription signup login search pagination pager toolbar complementary contentinfo skip tags".split()
)
# A region keeps these words' elements: an article's own header may hold its title.
WITHIN_REGION = frozenset(["header", "side", "bottom", "tags", "alert", "skip"])
_WORD = re.compile(r"[a-z]+")
SIGMA = 1.5


class Block:
    __slots__ = ("pieces", "text", "tags", "link", "region")

    def __init__(self, pieces: list[tuple[str, int, int]], tags: int, region: tuple[int, bool]):
        self.pieces, self.tags, self.region = pieces, tags, region
        self.text = " ".join("".join(p for p, _, _ in pieces).split())
        self.link = sum(n for _, n, _ in pieces)

    def without(self, left_out: set[int]) -> "Block":
        kept = [p for p in self.pieces if p[2] not in left_out]
        return self if len(kept) == len(self.pieces) else Block(kept, self.tags, self.region)


class BlockReader(HTMLParser):
    """Blocks of a page in order, without those that tags leave out, and the elements that names may leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.named: dict[int, bool] = {}  # by region number: whether a word alone is the name
        self.around: dict[int, int] = {0: 0}  # the named element around each named one; 0: none
        # name, left out, region number, named element around, what a block in it counts to
        self._stack: list[tuple[str, bool, int, int, tuple[int, bool]]] = []
        self._open: Counter[str] = Counter()
        self._regions = 0
        self._text: list[tuple[str, int, int]] = []  # text, its length if a link, named element around
        self._tags = 0

    def _out(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    def _region(self) -> tuple[int, bool]:
        """(number, whether an article or main element) of what a block here counts to: the outermost such element, else the innermost container."""
        return self._stack[-1][4] if self._stack else (0, False)

    def _end_block(self) -> None:
        if any(p.strip() for p, _, _ in self._text):
            self.blocks.append(Block(self._text, self._tags, self._region()))
        self._text, self._tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and not self._out():
            self._end_block()
        self._tags += 1
        if tag in VOID:
            self._text.append((" ", 0, 0))
            return
        if tag == "p":
            self._close("p", BLOCKS - {"p"})
        elif tag == "li":
            self._close("li", frozenset(["ul", "ol"]))
        elif tag in ("td", "th", "tr"):
            self._close(tag, frozenset(["table"]))
        region = self._region()
        inside = region[1]
        out = self._out() or tag in SKIPPED or (tag == "header" and not inside)
        out = out or (tag not in ("html", "body") and self._hidden(attrs))
        self._regions += 1
        around = self._stack[-1][3] if self._stack else 0
        if not out and tag not in ("html", "body") and tag not in REGIONS and (alone := self._name(attrs, inside)) is not None:
            self.named[self._regions], self.around[self._regions] = alone, around
            around = self._regions
        if not inside and tag in CONTAINERS:
            region = (self._regions, tag in REGIONS)
        self._stack.append((tag, out, self._regions, around, region))
        self._open[tag] += 1

    def _name(self, attrs: list[tuple[str, str | None]], inside: bool) -> bool | None:
        """None without a word for other parts of a page, else whether such a word alone is one of the names."""
        found = None
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                for token in value.lower().split():
                    words = _WORD.findall(token)
                    if any(w in BOILERPLATE and not (inside and w in WITHIN_REGION) for w in words):
                        found = found or len(words) == 1
        return found

    def _hidden(self, attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _close(self, tag: str, fence: frozenset[str]) -> None:
        """End an open element of this name, unless one of the fence lies between."""
        if not self._open[tag]:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                self._open.subtract(name for name, *_ in self._stack[k:])
                del self._stack[k:]
                return
            if self._stack[k][0] in fence:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self._out():
            self._end_block()
        self._tags += 1
        # an end tag inside a block does not close what lies around the block
        self._close(tag, frozenset() if tag in BLOCKS or tag in SKIPPED else BLOCKS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._stack and self._stack[-1][0] == tag and tag not in BLOCKS | SKIPPED:
            self._stack.pop()
            self._open[tag] -= 1

    def handle_data(self, data: str) -> None:
        if self._out():
            return
        link = any(name == "a" for name, *_ in self._stack[-3:])
        self._text.append((data, len(data.strip()) if link else 0, self._stack[-1][3] if self._stack else 0))

    def close(self) -> None:
        super().close()
        if not self._out():
            self._end_block()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends count as often as they are missed."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters: the one with the least squared distance to the two means."""
    v = np.sort(values)
    n = len(v)
    if n < 2 or v[0] == v[-1]:
        return -1.0
    total, square = np.cumsum(v), np.cumsum(v * v)
    k = np.arange(1, n)
    low = square[:-1] - total[:-1] ** 2 / k
    high = (square[-1] - square[:-1]) - (total[-1] - total[:-1]) ** 2 / (n - k)
    cost = np.where(v[1:] > v[:-1], low + high, np.inf)
    best = int(np.argmin(cost))
    return float((v[best] + v[best + 1]) / 2)


def _content(blocks: list[Block]) -> np.ndarray:
    """Whether each block's smoothed ratio of text to tags is above the threshold."""
    level = smoothed(np.array([(len(b.text) - b.link) / max(b.tags, 1) for b in blocks]))
    return level > threshold(level)


def _left_out(blocks: list[Block], named: dict[int, bool], around: dict[int, int]) -> set[int]:
    """The named elements that do not hold most of the text of high ratio, or all of it if a word alone names them; and those in them."""
    if not named or not blocks:
        return set()
    inside, total = dict.fromkeys(around, 0), 0
    regions = {b.region[0]: b.pieces[0][2] for b in blocks if b.region[1]}
    held = Counter(regions.values())
    for block, good in zip(blocks, _content(blocks)):
        if good:
            for text, link, number in block.pieces:
                n = len(text.strip()) - link
                total += n
                inside[number] += n
    # an element has a higher number than the one around it
    numbers = sorted(named)
    for number in reversed(numbers):
        inside[around[number]] += inside[number]
        held[around[number]] += held[number]
    out = set()
    for number in numbers:
        if named[number]:
            keep = 0 < total == inside[number] and held[number] == len(regions)
        else:
            keep = 2 * inside[number] > total
        if not keep or around[number] in out:
            out.add(number)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    left_out = _left_out(reader.blocks, reader.named, reader.around)
    blocks, tags = [], 0
    for block in reader.blocks:
        block = block.without(left_out)
        if block.text:
            # the tags of what is left out count to the next block
            block.tags += tags
            blocks.append(block)
        tags = 0 if block.text else tags + block.tags
    if not blocks:
        return ""
    regions = {b.region for b, good in zip(blocks, _content(blocks)) if good}
    # an article or main element that has content is the article, whatever else holds long text
    chosen = {r for r in regions if r[1]} or regions
    return "\n".join(b.text for b in blocks if b.region in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            texts = [main_text(html.as_py()) for html in column(part, "html")]
            sizes = [len(t) for t in texts]
            kept = part.select([n for n in part.schema.names if n != "html"])
            yield pa.record_batch(
                [*kept.columns, pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], [*kept.schema.names, "text", "n_chars"]
            )


def extract(pages: DataFrame) -> DataFrame:
    """The columns of `pages` but html, and text and n_chars; columns of these two names are replaced."""
    rows = pages.drop("text", "n_chars")
    others = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "html")
    return rows.mapInArrow(_extract, f"{others}, text string, n_chars bigint" if others else "text string, n_chars bigint")
