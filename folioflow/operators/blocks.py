"""HTML to blocks, paragraphs and links, on a small element tree built by the standard library's parser.

A paragraph ends where the next block begins, so an unclosed ``<p>`` doesn't repeat what follows it. Every text node is stripped and
non-empty ones are joined by one space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import clean_text
from folioflow.schemas import BLOCKS_TYPE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements before which an open element of the key ends.
ENDED_BY = {
    "p": frozenset("p table div ul ol h1 h2 h3 h4 h5 h6 section article footer header nav form blockquote pre hr".split()),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "li": frozenset(["li"]),
}
BARRIERS = frozenset(["table", "td", "th", "tr", "ul", "ol", "div"])
TOC_LINES, TOC_SHARE = 8, 0.8


ROWS = frozenset(["tr", "li", "p"])
CONTENTS = "table of contents"
PEEK = 60  # characters kept of an element's beginning
UNREAD = frozenset(["script", "style"])


class Node:
    """An element. ``near`` is the nearest element, itself or above, that a start tag may end or must not pass; ``row`` the nearest row, item or
    paragraph above; ``linked`` tells whether there is a link below; ``begun`` are the first words. All are kept while the tree is built, so that nothing climbs or walks it again."""

    __slots__ = ("tag", "attrs", "children", "parent", "near", "row", "linked", "begun")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent, self.linked = tag, attrs, [], parent, False
        self.begun = ""
        self.near = self if parent is None or tag in BARRIERS or tag in ENDED_BY else parent.near
        self.row = None if parent is None else parent if parent.tag in ROWS else parent.row

    def walk(self, within: Callable[[Node], bool] = lambda node: True) -> Iterator[Node]:
        """Elements below this one, in document order; of those that ``within`` denies only themselves. Depth costs no recursion."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    if c.children and within(c):
                        stack.append(iter(c.children))
                        break
            else:
                stack.pop()

    def strings(self, skip: frozenset = UNREAD) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    yield c
                elif c.tag not in skip:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, skip: frozenset = UNREAD) -> str:
        return " ".join(t for t in (s.strip() for s in self.strings(skip)) if t)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines aren't counted: nothing asks for them

    def close_up_to(self, node: Node) -> None:
        """End ``node`` and all that is open inside it."""
        while True:
            ended, self.at = self.at, self.at.parent
            self.open[ended.tag] -= 1
            if ended is node:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        node = self.at.near
        while node.parent is not None:
            if tag in ENDED_BY.get(node.tag, ()):
                self.close_up_to(node)
                break
            if node.tag in BARRIERS:
                break
            node = node.parent.near
        new = Node(tag, dict(attrs), self.at)
        self.at.children.append(new)
        if tag == "a":
            above = self.at
            while above is not None and not above.linked:
                above.linked, above = True, above.parent
        if tag not in VOID:
            self.at = new
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:  # else there is nothing to end, and nothing to look for
            node = self.at
            while node.tag != tag:
                node = node.parent
            self.close_up_to(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)
        words = data[:PEEK].strip() or data.strip()[:PEEK]
        above = self.at
        while words and above is not None and above.tag not in UNREAD and len(above.begun) < PEEK:  # above a full one all are full
            above.begun, above = f"{above.begun} {words}"[:PEEK + 1], above.parent


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def body_table(root: Node) -> Node | None:
    """The first table of class td: the text of a circular."""
    return next((n for n in root.walk() if n.tag == "table" and "td" in (n.attrs.get("class") or "").split()), None)


def _rows(table: Node) -> list[Node]:
    """The rows of a table, without those of tables inside it."""
    return [n for n in _own(table) if n.tag == "tr"]


def _own(table: Node) -> Iterator[Node]:
    return table.walk(lambda node: node.tag != "table")


def _cells(row: Node) -> list[Node]:
    return [n for n in _own(row) if n.tag in ("td", "th")]


def width(table: Node) -> int:
    """The cells of the widest row."""
    return max((len(_cells(r)) for r in _rows(table)), default=0)


def is_data(table: Node) -> bool:
    """Tables of one column lay out text, wider ones hold data."""
    return width(table) > 1


def is_contents(table: Node) -> bool:
    """A rendered table of contents: it says so, or it is a long list of which nearly every row is a link."""
    if clean_text(table.begun).lower().startswith(CONTENTS):
        return True
    rows = _rows(table)
    if len(rows) < TOC_LINES or any(len(_cells(r)) > 1 for r in rows) or width(table) != 1:
        return False
    return sum(r.linked for r in rows) / len(rows) >= TOC_SHARE


def markdown(rows: list[list[str]]) -> str:
    """Rows of cells as a pipe table; rows without text go, short rows are filled up."""
    columns = list(zip_longest(*(r for r in rows if any(r)), fillvalue=""))
    lines = [f"| {' | '.join(cells)} |" for cells in zip(*columns, strict=True)]
    return "\n".join([*lines[:1], "|" + " --- |" * len(columns), *lines[1:]]) if lines else ""


NO_NOTES = frozenset(["sup"])
PARAGRAPH = frozenset(["sup", "p"])  # a paragraph inside another one is a block of its own


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) in document order: paragraphs, and tables of two columns and more as markdown. Layout tables are looked through."""
    root = tree(html)
    root = body_table(root) or root
    out: list[tuple[str, str]] = []

    told: dict[Node, str] = {}

    def kind(table: Node) -> str:
        """What a table is for, found out once."""
        if table not in told:
            told[table] = "contents" if is_contents(table) else "data" if is_data(table) else "layout"
        return told[table]

    def looked_through(node: Node) -> bool:
        return node.tag != "sup" and not (node.tag == "table" and kind(node) != "layout")

    for node in root.walk(looked_through):
        if node.tag == "table" and kind(node) == "data":
            made = markdown([[clean_text(cell.text(NO_NOTES)) for cell in _cells(r)] for r in _rows(node)])
            if made:
                out.append(("table", made))
        elif node.tag == "p":
            text = clean_text(node.text(PARAGRAPH))
            if text:
                out.append(("text", text))
    return out


def blocks(html: Column | str) -> Column:
    """The blocks of a page as an array."""

    def made(column: pd.Series) -> pd.Series:
        return column.map(lambda h: [{"kind": k, "text": t} for k, t in blocks_of(h)])

    return F.pandas_udf(made, BLOCKS_TYPE)(html)


PARTS_TYPE = "paragraphs array<string>, hrefs array<string>, has_body boolean, anchors array<struct<text:string,href:string,row_text:string>>"


PART = UNREAD | {"p"}


def page_parts(html: Column | str) -> Column:
    """Non-empty paragraphs of the body table, all links, and anchors with the text of the row, item or paragraph around them."""

    def parts(column: pd.Series) -> pd.DataFrame:
        out = []
        for h in column:
            root = tree(h)
            body = body_table(root)
            paragraphs = [t for t in (n.text(PART) for n in body.walk() if n.tag == "p") if t] if body else []
            anchors, texts = [], {}
            for n in root.walk():
                if n.tag == "a" and n.attrs.get("href"):
                    around = n.row or n
                    if around not in texts:
                        texts[around] = around.text()
                    anchors.append({"text": n.text(), "href": n.attrs["href"], "row_text": texts[around]})
            out.append((paragraphs, [a["href"] for a in anchors], body is not None, anchors))
        return pd.DataFrame(out, columns=["paragraphs", "hrefs", "has_body", "anchors"])

    return F.pandas_udf(parts, PARTS_TYPE)(html)


def body_html(html: Column) -> Column:
    """Whether and where a page holds a body table, as the raw markup from its first tag on; null without one."""
    return F.nullif(F.regexp_extract(html, r"""(?is)(<table[^>]*class=["']?(?:[^"'>]*\s)?td(?:\s[^"'>]*)?["']?[^>]*>.*)""", 1), F.lit(""))
