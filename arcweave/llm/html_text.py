"""Main text of web pages by tag-path ratios (operator 9).

A page is cut into blocks, each with its root-to-leaf path of structural tags and classes (inline tags don't count, a paragraph ends where the
next block begins, unclosed tags end with their parent); scripts, styles, forms and the like are no blocks. For each path the lengths of its blocks' texts without links, and their
punctuation marks, are added up. The ratio of text is the sum times the mean of a block (many long blocks), that of punctuation the sum. Both are smoothed over the page's order of blocks and
multiplied; that is a block's fused ratio.

Paths whose mean fused ratio reaches a share of the page's mean are content paths. The deepest element that holds most of their blocks' fused ratios is the content node. Its blocks are kept where their own
ratio reaches a low threshold (headings and lists of the article do, lists of links don't), and blocks elsewhere where their path is a content path that the content node has too.

Telling names (of menus, headers, footers, sidebars, notices, adverts, comments) don't change a ratio. They count in two places alone: inside the content node a block with such a name has to reach the page's mean, and
on pages with less than SHORT characters of text, where ratios of a sentence or two say little, blocks with such a name are left out if there are others. A name that is part of a compound counts only where its
element holds less than half of the page's text, so that a wrapper called "with-sidebar" stays.

Reading is linear in the page's length: each character is read a bounded number of times, elements point to their parents, and what a path is called is a number. Null html is empty and gives an empty text, as does a page without
blocks; a tag that isn't closed ends at the next one; of equal ratios all are kept; an empty table gives no rows. Pages are independent, so repeated rows give repeated rows; other columns are ignored. A page is read whole, whatever its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read_table, slices

_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
_END = r"(?:>|(?=<)|\Z)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|object)\b{_ATTRIBUTES}{_END}.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^<>]*{_END}"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attributes>{_ATTRIBUTES}){_END}",
    re.DOTALL | re.IGNORECASE,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_BLOCKS = frozenset("head form button select".split())
NOT_CONTENT = frozenset("nav header footer aside menu dialog".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote caption figcaption".split())
ROOTS = frozenset(("article", "main"))
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation footer header masthead breadcrumb breadcrumbs comment comments "
    "commentlist disqus replies respond cookie cookies consent gdpr notice notices alert banner newsletter subscribe signup popup modal overlay related recommended share sharing "
    "social widget toolbar pagination pager navigation complementary contentinfo search".split()
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
#: A mark counts at the end of a word, so that those of numbers and addresses don't.
PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。，、؛،]")
#: Pages with fewer characters of text outside links have ratios that say little.
SHORT = 500


class Block(NamedTuple):
    element: int
    text: str
    linked: int  # characters in links
    marks: int  # punctuation

    @property
    def plain(self) -> int:
        return len(self.text) - self.linked


class Page:
    """The elements of a page in the order in which they open (0: the page itself), each with its parent, and the blocks in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.paths = [""], [-1], [0]
        self.left_out, self.telling, self.hinting = [False], [False], [False]
        self.labels: list[tuple[int, str]] = [(-1, "")]  # of each path: the path before its last label
        self.blocks: list[Block] = []
        self._read(source)

    def _open(self, parent: int, tag: str, attributes: str, numbers: dict[tuple[int, str], int]) -> int:
        names = [x for m in NAMED.finditer(attributes) for x in "".join(y or "" for y in m.groups()).lower().split()] if attributes else []
        label = (self.paths[parent], ".".join([tag, *names]))
        path = numbers.setdefault(label, len(self.labels))
        if path == len(self.labels):
            self.labels.append(label)
        judged = tag not in ROOTS and tag not in ("html", "body")
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(path)
        self.left_out.append(self.left_out[parent] or tag in NO_BLOCKS)
        self.telling.append(self.telling[parent] or tag in NOT_CONTENT or (judged and any(x in NAMES for x in names)))
        self.hinting.append(judged and any(w in NAMES for x in names for w in WORD.findall(x)))
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, held, numbers = [0], [], {}
        opened: Counter = Counter()
        link = linked = at = 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text and not self.left_out[stack[-1]]:
                    self.blocks.append(Block(stack[-1], text, min(linked, len(text)), len(PUNCTUATION.findall(text))))
                held.clear()
            linked = 0

        def close() -> str:
            tag = self.tags[stack.pop()]
            opened[tag] -= 1
            return tag

        for m in TOKEN.finditer(source):
            if m.start() > at:
                held.append(piece := source[at : m.start()])
                linked += len(piece) if link else 0
            at, tag = m.end(), (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in INLINE:
                link = max(0, link + (-1 if m["end"] else 1)) if tag == "a" else link
            elif tag == "br":
                held.append(" ")
            elif m["end"]:
                flush()
                if opened[tag] > 0:
                    while close() != tag:
                        pass
            else:
                flush()
                link = 0
                if tag in VOID:
                    continue
                if tag in ROOTS:  # an article is not inside a menu or header that was never closed
                    while any(opened[t] > 0 for t in SHUT):
                        close()
                while len(stack) > 1 and ((last := self.tags[stack[-1]]) in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (last == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"))):
                    close()
                stack.append(self._open(stack[-1], tag, m["attributes"] or "", numbers))
                opened[tag] += 1
        held.append(source[at:])
        flush()

    def path_names(self, path: int) -> tuple[str, ...]:
        out = []
        while path:
            path, label = self.labels[path]
            out.append(label)
        return tuple(reversed(out))

    def above(self, amounts: dict[int, float]) -> list[float]:
        """The amounts of elements, added up over all that an element holds."""
        out = [amounts.get(e, 0) for e in range(len(self.tags))]
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def named(self) -> list[bool]:
        """Whether an element has, or is in one that has, a telling name."""
        own: dict[int, float] = defaultdict(float)
        for b in self.blocks:
            own[b.element] += b.plain
        text = self.above(own)
        out = [False] * len(text)
        for e in range(1, len(out)):
            out[e] = out[self.parents[e]] or self.telling[e] or (self.hinting[e] and 2 * text[e] < text[0])
        return out


SHUT = NOT_CONTENT | NO_BLOCKS


def path_ratios(page: Page, blocks: list[Block]) -> dict[int, tuple[float, float]]:
    """The ratios of text and of punctuation (with one to begin with) of each path that blocks have."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 1, 0])
    for b in blocks:
        s = sums[page.paths[b.element]]
        s[0] += b.plain
        s[1] += b.marks
        s[2] += 1
    return {path: (s[0] * s[0] / s[2], float(s[1])) for path, s in sums.items()}


def smoothed(x: list[float], kernel: tuple[float, ...] = (1, 4, 1)) -> np.ndarray:
    k = len(kernel) // 2
    return np.convolve(np.pad(np.array(x), k, mode="edge"), np.array(kernel) / sum(kernel), mode="valid")


def main_text(source: str, threshold: float = 0.3, inner: float = 0.01, most: float = 0.65, short: int = SHORT) -> str:
    """threshold and inner: shares of the mean fused ratio (weighted by text) that a content path and a block of the content node have to reach; most: the share of the
    content paths' ratios that the content node holds."""
    page = Page(source)
    named, blocks = page.named(), page.blocks
    if sum(b.plain for b in blocks) < short:
        blocks = [b for b in blocks if not named[b.element]] or blocks
    if not blocks:
        return ""
    ratios = path_ratios(page, blocks)
    paths = [page.paths[b.element] for b in blocks]
    fused = (smoothed([ratios[p][0] for p in paths]) * smoothed([ratios[p][1] for p in paths])).tolist()
    mean = sum(f * b.plain for f, b in zip(fused, blocks, strict=True)) / max(1, sum(b.plain for b in blocks))
    by_path: dict[int, list[float]] = defaultdict(lambda: [0.0, 0])
    for p, f in zip(paths, fused, strict=True):
        by_path[p][0] += f
        by_path[p][1] += 1
    content = {p for p, (f, n) in by_path.items() if f >= threshold * mean * n > 0}
    amounts: dict[int, float] = defaultdict(float)
    for b, p, f in zip(blocks, paths, fused, strict=True):
        if p in content:  # a paragraph is no node
            amounts[page.parents[b.element] if page.tags[b.element] in PARAGRAPHS else b.element] += f
    held = page.above(amounts)
    # most is over a half, so the elements that hold it lie one in the other, and the last to open is the deepest
    node = max((e for e, f in enumerate(held) if f >= most * held[0] > 0), default=0)
    inside = [False] * len(held)
    for e in range(len(inside)):
        inside[e] = e == node or (e > node and inside[page.parents[e]])
    shared = {p for b, p in zip(blocks, paths, strict=True) if inside[b.element]} & content

    def kept(b: Block, p: int, f: float) -> bool:
        if not inside[b.element]:
            return p in shared
        return f >= mean * (1 - 1e-9) if named[b.element] else f >= inner * mean > 0  # as much as the mean, but for rounding

    return "\n".join(b.text for b, p, f in zip(blocks, paths, fused, strict=True) if kept(b, p, f))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each (page_id, url, html)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in slices(batches, "html"):
            texts = [main_text(x) for x in sources]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
