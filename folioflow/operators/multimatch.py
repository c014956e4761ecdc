"""Many needles against many texts in one pass: an automaton finds the candidates, only those are verified.

A needle is known by literals of which every match contains at least one; it may also have a pattern that decides. All literals go into one Aho-Corasick automaton
for each task, so a text is read once, however many needles there are. Needles of at most ``MOST_BYTES`` bytes in all, which is looked up first, are shipped to the tasks
and texts stay where they are. Beyond that, needles are dealt to as many groups as it takes, texts to blocks, and both meet in the cells of a grid, each with the automaton of its group.
Needles without a literal are tried on every text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.search import blocks, dealt
from folioflow.plans.materialize import spill

MOST_BYTES = 16 << 20
#: Bytes of text in a cell of the grid, and of memory that its needles may take, as a multiple of MOST_BYTES; what a needle and each byte of its literals take, as measured.
TEXT_BLOCK, CELL = 32 << 20, 16
NEEDLE, NODE = 48, 40
ROWS = 256  # texts of a batch whose pairs leave together

#: Letters that match an ASCII letter when case is ignored: fixed values.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """Text in which a literal stands wherever a pattern that ignores case can match it."""
    return text.lower() if text.isascii() else text.translate(ALIKE).lower()


#: A pattern that is a literal with edges of words before it: what comes after it is matched where the literal ends.
FIXED = re.compile(r"((?:\\[bB])*)([^\\.^$*+?{}\[\]|()]+)((?![*+?{]).*)", re.DOTALL)


class Finder:
    """The automaton of some needles, given as (literals, pattern or None).

    A pattern that is its literal, edges of words before it and something after it, is decided where the literal stands; parts of patterns that many share are compiled once.
    Other patterns are compiled when their literal is first met, and searched for in the whole text.
    """

    def __init__(self, needles: Iterable[tuple[list[str], str | None]], fold: bool):
        self.fold, self.always, self.flags = fold, [], re.IGNORECASE if fold else 0
        self.patterns: list[str | None] = []
        self.parts: dict[tuple[str, str], tuple[Callable, Callable] | None] = {}
        self.compiled: dict[int, Callable] = {}
        held: dict[str, tuple] = {}
        for at, (literals, pattern) in enumerate(needles):
            self.patterns.append(pattern)
            fixed = self.fixed(pattern, literals) if pattern is not None and literals else None
            for literal in literals or ():
                held[literal] = (*held.get(literal, (len(literal),)), (at, *fixed) if fixed else at)
            if not literals:
                self.always.append(at)
        self.automaton = ahocorasick.Automaton()
        while held:
            self.automaton.add_word(*held.popitem())
        if len(self.automaton):
            self.automaton.make_automaton()

    def fixed(self, pattern: str, literals: list[str]) -> tuple[Callable, Callable] | None:
        """What to match before and after the literal, where that decides."""
        hit = FIXED.fullmatch(pattern)
        if not hit or len(literals) != 1 or hit[2].lower() != literals[0] or not hit[2].isascii() or (not self.fold and hit[2] != literals[0]):
            return None
        key = (hit[1], hit[3])
        if key not in self.parts:
            try:
                branched = re.compile(hit[3], self.flags) and "|" in re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\([^()|]*(?:\|[^()|]*)*\)", "", hit[3])
                self.parts[key] = None if branched else (re.compile(hit[1], self.flags).match, re.compile(hit[3], self.flags).match)
            except re.error:  # a part alone is no pattern
                self.parts[key] = None
        return self.parts[key]

    def search(self, at: int) -> Callable | None:
        if self.patterns[at] is None:
            return None
        if at not in self.compiled:
            if len(self.compiled) >= 10_000:
                self.compiled.clear()
            self.compiled[at] = re.compile(self.patterns[at], self.flags).search
        return self.compiled[at]

    def __call__(self, text: str) -> list[int]:
        """The needles that ``text`` holds, in their order."""
        found, maybe = set(), set(self.always)
        if len(self.automaton):
            for end, (length, *numbers) in self.automaton.iter(folded(text) if self.fold else text):
                for n in numbers:
                    if type(n) is int:
                        maybe.add(n)
                    elif n[0] not in found and n[1](text, end + 1 - length) and n[2](text, end + 1):
                        found.add(n[0])
        for at in maybe:
            search = self.search(at)
            if search is None or search(text):
                found.add(at)
        return sorted(found)


def matches(texts: DataFrame, needles: DataFrame, fold: bool = False) -> DataFrame:
    """(text_id, needle_id) for texts (text_id, text) and needles (needle_id, literals, pattern): which text holds which needle.

    A needle whose pattern is null is held by every text with one of its literals. With ``fold`` patterns ignore case, and literals must be lower-case. Null texts hold nothing.
    """
    kept = spill(needles.select("needle_id", "literals", "pattern"), "needles")
    size = F.octet_length(F.concat_ws("", "literals")) + F.coalesce(F.octet_length("pattern"), F.lit(0)) + 16
    memory = size + F.lit(NEEDLE) + NODE * F.octet_length(F.concat_ws("", "literals"))
    total, inside = kept.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(memory), F.lit(0))).first()
    rows = texts.select("text_id", "text").filter(F.col("text").isNotNull())
    out = f"text_id {rows.schema['text_id'].dataType.simpleString()}, needle_id {kept.schema['needle_id'].dataType.simpleString()}"
    if total <= MOST_BYTES:  # looked up: what the driver and every task hold is bounded
        held = kept.toArrow()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _finder(held, fold)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield from _pairs(pa.Table.from_batches([batch.slice(at, ROWS)]), held, find).to_batches()

        return rows.mapInArrow(scan, out)

    groups = blocks(inside, CELL * MOST_BYTES)
    text_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    down = blocks(text_bytes, TEXT_BLOCK)
    left = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_b", dealt(F.col("text_id"), F.lit(down)))
    right = kept.withColumn("_g", dealt(F.col("needle_id"), F.lit(groups))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

    def cell(texts: pa.Table, held: pa.Table) -> pa.Table:
        return _pairs(texts, held, _finder(held, fold))

    return left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInArrow(cell, out)


def _finder(held: pa.Table, fold: bool) -> Finder:
    return Finder(((literals.as_py(), pattern.as_py()) for literals, pattern in zip(held["literals"], held["pattern"], strict=True)), fold)


def _pairs(texts: pa.Table, held: pa.Table, find: Finder) -> pa.Table:
    rows, found = array("q"), array("q")  # a pair is two numbers, not two objects
    for at, text in enumerate(texts["text"]):
        hits = find(text.as_py())
        rows.extend([at] * len(hits))
        found.extend(hits)
    at, of = (pa.Array.from_buffers(pa.int64(), len(x), [None, pa.py_buffer(x)]) for x in (rows, found))
    return pa.table({"text_id": texts["text_id"].take(at), "needle_id": held["needle_id"].take(of)})
