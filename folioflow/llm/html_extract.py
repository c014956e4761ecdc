"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. Block-level tags cut the stream into lines; a line knows its text, its tags, how much of
it is link text, whether it is a heading, and the container (``CONTAINERS``) it lies in. Scripts, styles and what else isn't shown give no lines.

The ratio of a line is its text outside links over its tags. Features change it: text inside an ``article`` or ``main`` element counts
``INSIDE`` times; text in menus, headers, footers, sidebars and forms that say so by their element or role, or by a name (a class or id) of furniture, counts ``NAMED`` times, under a name inside
an article ``DOUBTFUL`` times. Neither removes text by itself: what is so marked stays where its smoothed ratio makes it a region in spite of that. Ratios are smoothed by a Gaussian; the content
regions are lines whose smoothed ratio is above ``SHARE`` of the mean, as is their own: smoothing takes out single long lines among short ones. The root of the content is the innermost container that holds ``MOST`` of the
text of all regions. What is kept lies in the root: regions, what is between them, and short lines and headings beside
them. Unless the root is an article, what only holds links, and containers with less than ``EDGE`` of the regions' text, go at either end. A
heading right before the root is kept, and of articles side by side all that have a region. A name counts as one of furniture if all its words speak of
furniture or of layout, so ``related`` does and ``related-work`` doesn't, and never at or around the root. A line of marked and other text is judged by the other text, and keeps that alone.

Character references are decoded, white space inside a block becomes one space, and blocks are joined in page order by one space.
Null and empty pages, and pages without text, give the empty text; a page of nothing but links gives their text. Tags that aren't closed, or not
opened, don't break anything, and cost no search of what is open. Pages of any length are read whole, one at a time. Rows are
independent: repeated rows, ties and null ids need no rule, and other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
SHARE = 0.6  # of the mean smoothed ratio
MOST = 0.9  # of the regions' text lies in the root
EDGE = 0.05
INSIDE, NAMED, DOUBTFUL = 5.0, 0.05, 0.3
# fixed values: the HTML elements of each kind
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body center div footer form header main nav section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form fieldset button select option textarea input menu dialog search".split())
UNSEEN = frozenset("script style noscript template svg math canvas object iframe audio video head title".split())
WALLS = frozenset("article div section td li body".split())  # a paragraph outside isn't ended inside
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond disqus replies reply widget toolbar copyright disclaimer skip".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center column container content div entry form fixed global group icons inline inner item items js left link links list main middle outer page panel post posts primary right row secondary section site sticky thread to top unit user wrap wrapper".split()
)
KEYWORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _is_furniture(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Whether the tag or a role makes an element furniture."""
    if tag in FURNITURE:
        return not (tag == "header" and in_article)
    return (attrs.get("role") or "").lower() in ROLES


def _is_unseen(tag: str, attrs: dict[str, str | None]) -> bool:
    return tag in UNSEEN or "hidden" in attrs or attrs.get("aria-hidden") == "true"


def _is_named_so(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Whether a class or id is a name of furniture."""
    if tag in ("html", "body", "main", "article") and not (tag == "article" and in_article):
        return False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in KEYWORD.findall(name)]
        telling = [w for w in words if w in WORDS]
        if (telling and all(w in WORDS or w in LAYOUT for w in words)) or "".join(words) in WORDS:
            if not (in_article and set(telling) <= {"header", "masthead"} and telling):
                return True
    return False


#: A piece of text: the text, whether it is in a link, the innermost named element, whether it is in furniture.
Piece = tuple[str, bool, int, bool]


class _Page(HTMLParser):
    """Collects the lines of a page, and its containers and named elements as trees."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[Piece], int, int, bool]] = []  # pieces, tags, container, whether a heading
        self.text: list[Piece] = []
        self.tags = 0
        self.stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]  # tag, unseen, in furniture, container, innermost named element
        self.open: Counter[str] = Counter()
        self.paragraphs: list[int] = []  # places in the stack, and of what stops their being ended
        self.walls: list[int] = []
        self.named = [(0, 0, True)]  # elements with names of furniture: the one around, the depth, whether all stand inside an article
        self.parent, self.article, self.name_of = [0], [0], [0]  # of containers: the one around, the outermost article, the named element
        self.in_link = self.in_heading = 0

    def cut(self) -> None:
        if self.text:
            self.lines.append((self.text, self.tags, self.stack[-1][3], self.in_heading > 0))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.cut()
            self.leave("head")
        if tag in CLOSES_P and self.paragraphs and (not self.walls or self.paragraphs[-1] > self.walls[-1]):
            self.end(self.paragraphs[-1])
        self.tags += 1
        if tag in VOID:
            return
        _, unseen, furniture, container, named = self.stack[-1]
        in_article = self.article[container] > 0
        unseen = unseen or _is_unseen(tag, dict(attrs))
        furniture = furniture or _is_furniture(tag, dict(attrs), in_article)
        if not furniture and not unseen and _is_named_so(tag, dict(attrs), in_article):
            self.named.append((named, self.named[named][1] + 1, in_article and self.named[named][2]))
            named = len(self.named) - 1
        if tag in CONTAINERS and not furniture and not unseen:
            self.parent.append(container)
            container = len(self.parent) - 1
            self.article.append(self.article[self.parent[-1]] or (container if tag in ("article", "main") else 0))
            self.name_of.append(named)
        if tag == "p":
            self.paragraphs.append(len(self.stack))
        elif tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((tag, unseen, furniture, container, named))
        self.open[tag] += 1
        self.in_link += tag == "a"
        self.in_heading += tag in HEADINGS

    def end(self, at: int) -> None:
        """End the element at a place of the stack and all inside it."""
        for tag, *_ in self.stack[at:]:
            self.open[tag] -= 1
            self.in_link -= tag == "a"
            self.in_heading -= tag in HEADINGS
        del self.stack[at:]
        for places in (self.paragraphs, self.walls):
            while places and places[-1] >= at:
                places.pop()

    def leave(self, tag: str) -> None:
        """End the innermost element of a tag, if one is open: only what is ended is looked at."""
        if self.open[tag] > 0:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.end(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        _, unseen, furniture, _, named = self.stack[-1]
        if not unseen:
            self.text.append((data, self.in_link > 0, named, furniture))

    def around(self, container: int) -> set[int]:
        """The named elements around a container."""
        return self.up(self.name_of[container])

    def up(self, n: int) -> set[int]:
        """A named element and those around it."""
        out = {0}
        while n not in out:
            out.add(n)
            n = self.named[n][0]
        return out

    def shown(self) -> set[int]:
        """The named elements that hold the page's articles: those around the outermost articles inside the fewest of them."""
        tops = [a for a in set(self.article) if a]
        least = min((self.named[self.name_of[a]][1] for a in tops), default=0)
        return {0}.union(*(self.around(a) for a in tops if self.named[self.name_of[a]][1] == least))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian; its weights are scaled to what lies inside the page."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mid = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[mid] / np.convolve(np.ones(len(ratios)), kernel)[mid]


def _plain(pieces: list[Piece], shown: set[int]) -> list[Piece]:
    """The pieces that no element or name marks as furniture."""
    return [p for p in pieces if not p[3] and p[2] in shown]


def _bare(pieces: list[Piece]) -> str:
    return " ".join("".join(p[0] for p in pieces).split())


def _written(pieces: list[Piece], shown: set[int], region: bool) -> str:
    """The text of a line: its unmarked pieces; where all are marked, the line if it is a region."""
    return _bare(_plain(pieces, shown)) or (_bare(pieces) if region else "")


def _root(page: _Page, own: np.ndarray, container: np.ndarray) -> tuple[int, np.ndarray]:
    """The innermost container with ``MOST`` of the text ``own``, and the text that each container holds."""
    held = np.bincount(container, own, len(page.parent))
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    root = 0
    for i in range(1, len(held)):  # containers come after the one around them
        if page.parent[i] == root and held[i] >= MOST * held[0]:
            root = i
    return root, held


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.cut()
    lines = [x for x in page.lines if any(not p[0].isspace() for p in x[0])]
    shown = page.shown()
    if not any(_bare(_plain(x[0], shown)) for x in lines):
        return ""
    container = np.array([x[2] for x in lines])
    article = np.array(page.article)

    def weighed(pieces: list[Piece], links: bool) -> float:
        """The length of a line's text; of marked text, if there is no other, a share."""
        plain = [p for p in _plain(pieces, shown) if links or not p[1]]
        if any(not p[0].isspace() for p in plain):
            return float(sum(len(p[0].strip()) for p in plain))
        return sum((DOUBTFUL if page.named[p[2]][2] and not p[3] else NAMED) * len(p[0].strip()) for p in pieces if links or not p[1])

    own = np.array([weighed(x[0], False) for x in lines])
    if not own.any():
        own = np.array([weighed(x[0], True) for x in lines])
    own = np.where(article[container] > 0, INSIDE * own, own)
    ratio = own / (np.array([x[1] for x in lines]) + 1.0)
    soft = smoothed(ratio)
    region = (soft >= SHARE * soft.mean()) & (ratio >= SHARE * soft.mean())
    if not region.any():
        region = own > 0
    root, held = _root(page, np.where(region, own, 0.0), container)
    shown = shown.union(page.around(root), *(page.up(p[2]) for x, r in zip(lines, region, strict=True) if r for p in x[0] if not p[3]))  # a named element with a region is content
    under, top = np.zeros(len(page.parent), bool), np.arange(len(page.parent))
    under[root] = True
    for i in range(root + 1, len(under)):
        under[i] = under[page.parent[i]]
        top[i] = i if page.parent[i] == root else top[page.parent[i]]
    texts = [_written(x[0], shown, bool(r)) for x, r in zip(lines, region, strict=True)]
    heading = np.array([x[3] for x in lines])
    keep = under[container]
    if article[root]:
        keep |= (article[container] > 0) & (held[article[container]] > 0)
    else:
        solid = (own > 0) & ((container == root) | (held[top[container]] >= EDGE * held[0])) & np.array([bool(t) for t in texts])
        at = np.flatnonzero(keep & solid)
        last = at[-1] + 1 if len(at) else 0
        ahead = np.flatnonzero(keep & (solid | heading))
        keep[: ahead[0] if len(ahead) else 0] = False
        keep[last:] = False
    at = np.flatnonzero(keep)
    before = int(at[0]) - 1 if len(at) else -1
    while before >= 0 and heading[before]:
        keep[before], before = True, before - 1
    return " ".join(t for t, k in zip(texts, keep.tolist(), strict=True) if k and t)


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in the column ``out``, which replaces one of that name."""

    @F.pandas_udf("string")
    def texts(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([main_text(h) for h in column], dtype=object)

    return pages.withColumn(out, texts(F.col(f"`{html_col}`")))
