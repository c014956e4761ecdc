"""Boolean trigram queries derived from regular expressions.

A pattern is walked once. Stretches whose possible strings are few become sets of strings; a set means: for one of its
strings, all trigrams. Stretches are joined by AND, alternatives by OR. What no trigram constrains is ``True``.
Trigrams are in ASCII lower case, so a query suits both case-sensitive and case-insensitive rules.

The patterns may hold literals, escapes, classes, groups, alternatives, anchors, greedy, lazy and possessive quantifiers, look-arounds (which
constrain nothing here) and leading flags; anything else is refused.
"""

from __future__ import annotations

import re

FEW = 128  # possible strings followed at once
SMALL_CLASS = 8  # characters of a class that are still followed


def derive(pattern: str):
    """The query of a pattern: a trigram, ("and", [...]), ("or", [...]) or True."""
    exact, query = _walk(parse(pattern))
    return _and([query, _strings(exact)]) if exact is not None else query


def vocabulary(query) -> set[str]:
    """The trigrams that a query names."""
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(vocabulary, query[1]))


def matches(query, present: set[str]) -> bool:
    """Whether a document with these trigrams may match."""
    if query is True or isinstance(query, str):
        return query is True or query in present
    return (all if query[0] == "and" else any)(matches(q, present) for q in query[1])


def _trigrams(text: str):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _and(sorted({low[i : i + 3] for i in range(len(low) - 2)}))


def _strings(exact: set[str]):
    return _or([_trigrams(s) for s in sorted(exact)])


def _and(parts):
    flat = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if q is not True and q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts):
    if not parts or any(p is True for p in parts):
        return True
    sets = [frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" and all(isinstance(q, str) for q in p[1]) else frozenset([p]) if isinstance(p, str) else None for p in parts]
    kept = []
    for i, (p, s) in enumerate(zip(parts, sets, strict=True)):
        wider = any(t is not None and s is not None and (t < s or t == s and j < i) for j, t in enumerate(sets))
        if not wider and p not in kept:
            kept.append(p)
    return kept[0] if len(kept) == 1 else ("or", kept)


CODED = re.compile(r"x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|x\{([0-9A-Fa-f]+)\}")
CONTROLS = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d+)(,?)(\d*)\})[?+]?")
MANY = 1 << 30


def parse(pattern: str) -> list[tuple]:
    """The pattern as nodes: ("set", characters or None for many), ("empty",), ("any of", branches), ("repeat", least, most, nodes)."""
    reader = _Reader(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern))
    nodes = reader.branches()
    if reader.at < len(reader.text):
        raise ValueError(f"unbalanced parenthesis: {pattern}")
    return nodes


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self, *starts: str) -> bool:
        """Step over the first of ``starts`` that comes next."""
        for s in starts:
            if self.text.startswith(s, self.at):
                self.at += len(s)
                return True
        return False

    def branches(self) -> list[tuple]:
        each = [self.sequence()]
        while self.next("|"):
            each.append(self.sequence())
        return each[0] if len(each) == 1 else [("any of", each)]

    def sequence(self) -> list[tuple]:
        nodes = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            atom = self.atom()
            found = QUANTIFIER.match(self.text, self.at)
            if found:
                self.at = found.end()
                sign, low, comma, high = found.groups()
                least = int(low) if low else int(sign == "+")
                most = (int(high) if high else MANY if comma else least) if low else 1 if sign == "?" else MANY
                atom = [("repeat", least, most, atom)]
            nodes += atom
        return nodes

    def atom(self) -> list[tuple]:
        if self.next("("):
            around = self.next("?=", "?!", "?<=", "?<!")
            if not around and not self.next("?:", "?>") and self.next("?P<", "?<"):
                self.at = self.text.index(">", self.at) + 1
            elif self.text.startswith("?", self.at):
                raise ValueError(f"unknown group: {self.text}")
            inside = self.branches()
            if not self.next(")"):
                raise ValueError(f"missing parenthesis: {self.text}")
            return [("empty",)] if around else [("any of", [inside])]
        if self.next("["):
            return [("set", self.characters())]
        if self.next("."):
            return [("set", None)]
        if self.next("^", "$", r"\b", r"\B", r"\A", r"\Z", r"\z"):
            return [("empty",)]
        return [("set", self.one())]

    def one(self) -> set[str] | None:
        """A character, or those of an escape."""
        if not self.next("\\"):
            self.at += 1
            return {self.text[self.at - 1]}
        coded = CODED.match(self.text, self.at)
        if coded:
            self.at = coded.end()
            return {chr(int(next(filter(None, coded.groups())), 16))}
        self.at += 1
        c = self.text[self.at - 1]
        if c in CONTROLS:
            return {CONTROLS[c]}
        if c.isalnum() and c not in "dDwWsShHpP":
            raise ValueError(f"unknown escape: {self.text}")
        if c in "pP":
            self.at = self.text.index("}", self.at) + 1
        return None if c.isalnum() else {c}

    def characters(self) -> set[str] | None:
        """The characters of a class, or None where they are many or negated."""
        many = self.next("^")
        found: set[str] = set()
        first = True
        while first or not self.text.startswith("]", self.at):
            if self.at >= len(self.text):
                raise ValueError(f"missing bracket: {self.text}")
            low, first = self.one(), False
            if low and self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                self.at += 1
                a, b = ord(min(low)), ord(min(self.one() or {"\0"}))
                low = {chr(c) for c in range(a, b + 1)} if b - a < SMALL_CLASS else None
            many = many or low is None
            found |= low or set()
        self.at += 1
        return None if many or len(found) > SMALL_CLASS else found


def _walk(nodes: list[tuple]):
    """(strings, query): all strings that the nodes match, or None; and what holds besides."""
    exact, queries, whole = {""}, [], True
    for node in nodes:
        own, query = _own(node)
        if own is not None and len(own) * len(exact) <= FEW:
            exact = {a + b for a in exact for b in own}
            queries.append(query)
        else:
            queries += [_strings(exact), _and([query, _strings(own)]) if own is not None else query]
            exact, whole = {""}, False
    return (exact, _and(queries)) if whole else (None, _and([*queries, _strings(exact)]))


def _own(node: tuple):
    """``_walk`` for one node."""
    if node[0] == "set":
        return node[1], True
    if node[0] == "empty":
        return {""}, True
    if node[0] == "any of":
        each = [_walk(branch) for branch in node[1]]
        if len(each) == 1:
            return each[0]
        if all(strings is not None and query is True for strings, query in each):
            return set().union(*(strings for strings, _ in each)), True
        return None, _or([_and([query, _strings(strings)]) if strings is not None else query for strings, query in each])
    _, least, most, inner = node
    strings, query = _walk(inner)
    if strings is not None and query is True:
        if most == 1:
            return strings | ({""} if least == 0 else set()), True
        if 1 <= least == most and len(strings) ** least <= FEW:
            made = {""}
            for _ in range(least):
                made = {a + b for a in made for b in strings}
            return made, True
    if least == 0:
        return None, True
    return None, _and([query, _strings(strings)]) if strings is not None else query
