"""Dictionaries of patterns as tables: which terms a text names, for any number of terms.

A dictionary has (term_id, pattern) and whatever else belongs to a term. From each pattern the literals are taken of which every match contains one; they find
the candidates, see ``multimatch``, and only those patterns are run. Patterns are Python's, case is ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.multimatch import matches

#: Escapes that stand for a place, not a character; other letters stand for kinds of characters.
PLACES = frozenset("bBAZ")
#: How often the thing before may occur.
COUNT = re.compile(r"(?:([*+?])|\{(\d*),?\d*\})[?+]?")
#: What a group begins with.
OPENING = re.compile(r"\((?:\?(?:P<\w+>|[aiLmsu-]*:|>|<?[=!]|#[^)]*\)|[aiLmsu]+\)))?")
#: Spellings that aren't read: numbered characters, earlier groups, conditions, free spacing.
UNREAD = re.compile(r"\\[xuUN0-9]|\(\?\(|\(\?P=|\(\?[aiLmsu-]*x")
Literals = frozenset[str]


def mandatory(pattern: str) -> Literals | None:
    """ASCII literals, lower-case, of which every match of ``pattern`` contains at least one; None where the pattern commands none.

    A pattern is read for what it commands: characters that must follow one another, and groups all of whose branches command something. Of all that a
    sequence commands, the set whose shortest literal is longest is taken. What isn't understood commands nothing.
    """
    if UNREAD.search(pattern):
        return None
    found, at = _branches(pattern, 0)
    return found if at == len(pattern) else None


def _branches(p: str, at: int) -> tuple[Literals | None, int]:
    """What the branches up to a closing bracket command together, and where that bracket is."""
    sets, more = [], True
    while more:
        found, at = _sequence(p, at)
        sets.append(found)
        more = p[at : at + 1] == "|"
        at += more
    return (None if None in sets else frozenset().union(*sets)), at


def _sequence(p: str, at: int) -> tuple[Literals | None, int]:
    commanded: list[Literals] = []
    run = ""
    while at < len(p) and p[at] not in "|)":
        kind, value, end = _thing(p, at)
        least, after = _least(p, end)
        at = after
        if kind == "place":
            continue
        if kind == "character" and value and least:
            run += value
        if kind != "character" or not value or after > end:  # what follows needn't stand next to the run
            commanded.append(frozenset([run]))
            run = ""
            if kind == "group" and value and least:
                commanded.append(value)
    commanded.append(frozenset([run]))
    best = max(commanded, key=lambda s: (min(map(len, s)), -len(s)))
    return (best if min(map(len, best)) else None), at


def _thing(p: str, at: int) -> tuple[str, str | Literals | None, int]:
    """What stands at a place (a character, a group, a place between characters, anything else), what it commands, where it ends."""
    c = p[at]
    if c == "(":
        head = OPENING.match(p, at)[0]
        if head.endswith(")"):  # flags and comments
            return "place", None, at + len(head)
        inner, end = _branches(p, at + len(head))
        return ("place" if head.endswith(("=", "!")) else "group"), inner, end + 1
    if c == "[":
        end = at + 1 + (p[at + 1 : at + 2] == "^")
        end += p[end : end + 1] == "]"
        while end < len(p) and p[end] != "]":
            end += 1 + (p[end] == "\\")
        return "other", None, end + 1
    if c in "^$":
        return "place", None, at + 1
    if c == "\\":
        e = p[at + 1 : at + 2]
        if e.isalnum():
            return ("place" if e in PLACES else "other"), None, at + 2
        return "character", (e if e.isascii() else None), at + 2
    return ("other" if c == "." else "character"), (c.lower() if c.isascii() else None), at + 1


def _least(p: str, at: int) -> tuple[int, int]:
    """(0 or 1 time at least, where the count ends) of the count at a place; once without a count."""
    hit = COUNT.match(p, at)
    if not hit:
        return 1, at
    return (1 if hit[1] == "+" or int(hit[2] or 0) > 0 else 0), hit.end()


def literals(pattern: Column) -> Column:
    """The mandatory literals of a column of patterns; an empty array where there are none."""

    @F.pandas_udf("array<string>")
    def taken(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: sorted(mandatory(p) or ()) if p is not None else [])

    return taken(pattern)


def named(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text_id, term_id): which terms of ``dictionary`` (term_id, pattern) each of ``texts`` (text_id, text) names. Null patterns name nothing."""
    terms = dictionary.filter(F.col("pattern").isNotNull()).select(F.col("term_id").alias("needle_id"), literals(F.col("pattern")).alias("literals"), "pattern")
    return matches(texts, terms, fold=True).withColumnRenamed("needle_id", "term_id")
