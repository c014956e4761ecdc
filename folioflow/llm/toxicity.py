"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: case, homoglyphs of other alphabets, and digits or signs that stand for letters in a word. A spelling that can be
read in several ways (1 for i or l; @ or $ at the start or end, a letter or none) is read as the lexicon word among its readings. The lexicon and its
weights are learned from a bounded sample of labelled rows (``TRAIN_ROWS``): a word's weight is its log-odds between toxic and
clean documents, and words enter by their G statistic, which must exceed what chance brings among so many words. A word counts once for each pair of neighbours it is seen with, so copies of one
document don't make its words look telling. Phrases of two words that are common in clean documents are exceptions: their words don't count, however many phrases hold them. The
weights found in a text are set against its length, and a logistic curve, fitted on the same sample and moved so that from ``THRESHOLD`` on a share of ``PRECISION`` of
its rows is toxic, turns them into a score in [0, 1].

Null and empty texts have no matches and get the score of a text without matches. Without labelled rows of both kinds every score is 0. Labels, languages, sources and
ids are no inputs of a score. Rows are independent: repeated rows, ties and null ids need no rule, and other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.training import chance, held_out, sampled, slices
from folioflow.plans.materialize import spill

TRAIN_ROWS = 30_000
LEXICON = 400
LEAST_WEIGHT = 1.5
MOST_WEIGHT = 6.0
EXCEPTION_SUPPORT = 5
THRESHOLD, PRECISION = 0.7, 0.98
# fixed values: letters of other alphabets that look like Latin ones
HOMOGLYPHS = str.maketrans("авеіјкмнорстухԁѕαειοκνρτυχ", "abeijkmhopctyxdsaeiokvptyx")
# fixed values: digits and signs written for letters
DIGITS = str.maketrans("0134578@$", "oieastbas")
SIGNS = "@$"
TOKEN = re.compile(r"[@$]{0,2}[^\W_]+(?:[@$]+[^\W_]+)*(?:[@$]{1,2}(?![@$]))?")  # three signs and more at the end are a rule, not letters
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof")


def fold(text: str | None, known: dict[str, list[str]] | None = None) -> list[str]:
    """The folded words of a text. A spelling with several readings takes the one in ``known`` (see ``Lexicon.readings``), if any."""
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(HOMOGLYPHS)
    return [w if w.isalpha() or w.isdigit() else _read(w, known) for w in TOKEN.findall(low)]


def _read(token: str, known: dict[str, list[str]] | None) -> str:
    """A word written with digits or signs: 1 is i or l, a sign at either end is a letter or none."""
    core = token.strip(SIGNS)
    if core.isdigit():
        return core
    if known:
        lead, trail = len(token) - len(token.lstrip(SIGNS)), len(token) - len(token.rstrip(SIGNS))
        for i in range(lead + 1):
            for j in range(trail + 1):
                part = token[i : len(token) - j]
                turned = part.translate(DIGITS)
                for word in known.get(turned.replace("l", "i"), ()):
                    if all(w == t or (p == "1" and w == "l") for w, t, p in zip(word, turned, part, strict=True)):
                        return word
    return token.translate(DIGITS)


@dataclass
class Lexicon:
    """Weights of words, phrases in which words don't count, and the curve from weights to a score."""

    weights: dict[str, float]
    exceptions: dict[str, list[str]] = field(default_factory=dict)
    curve: tuple[float, ...] = ()

    @cached_property
    def readings(self) -> dict[str, list[str]]:
        """The words by their spelling with i for l."""
        found: dict[str, list[str]] = {}
        for word in self.weights:
            found.setdefault(word.replace("l", "i"), []).append(word)
        return found

    def automaton(self):
        """Words and phrases between spaces: (length, weight, None) of a word, (length, 0, places of the words that don't count) of a phrase."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(f" {word} ", (len(word) + 2, weight, None))
        for phrase, words in self.exceptions.items():
            parts, at, places = phrase.split(" "), 0, []
            for part in parts:
                if part in words:
                    places.append(at)
                at += len(part) + 1
            if len(parts) > 1:
                found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, places))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str | None, automaton) -> tuple[float, float]:
        """(log of the weights found, log of the weights found per hundred words). A word in several exception phrases is left out once."""
        words = fold(text, self.readings)
        if not words or not self.weights:
            return 0.0, 0.0
        found, excused = {}, set()
        for end, (size, weight, places) in automaton.iter(f" {' '.join(words)} "):
            start = end + 1 - size
            if places is None:
                found[start] = weight
            else:
                excused.update(start + p for p in places)
        total = sum(weight for start, weight in found.items() if start not in excused)
        return float(np.log1p(total)), float(np.log1p(100.0 * total / (len(words) + 20.0)))

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(a))
        return 1.0 / (1.0 + np.exp(-(self.curve[0] + self.curve[1] * a + self.curve[2] * b)))


def fit_curve(a: np.ndarray, b: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.stack([np.ones(len(a)), a, b], axis=1)
    w = np.zeros(3)
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * np.array([0, w[1], w[2]])
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, before, after, toxic) for the first place of each distinct word of a text."""
    for frame in slices(frames, 256):
        out = []
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = ["", *fold(text), ""]
            seen = set()
            for before, word, after in zip(words, words[1:], words[2:], strict=False):
                if word not in seen and len(word) > 2:
                    seen.add(word)
                    out.append((word, before, after, toxic))
        yield pd.DataFrame(out, columns=["word", "before", "after", "toxic"])


def shifted(curve: tuple[float, ...], scores: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The curve moved so that THRESHOLD is the least score from which on the share of toxic rows is at least PRECISION."""
    order = np.argsort(-scores, kind="stable")
    ranked, hits = scores[order], np.cumsum(y[order])
    last = np.append(ranked[1:] != ranked[:-1], True)  # rows of one score stand or fall together
    good = last & (hits / np.arange(1, len(y) + 1) >= PRECISION)
    if not good.any():
        return curve
    at = int(np.flatnonzero(good)[-1])
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    cut = np.clip((ranked[at] + below) / 2, 1e-6, 1 - 1e-6)
    return (curve[0] + float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut))), *curve[1:])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    at_most: int = TRAIN_ROWS, size: int = LEXICON,
) -> Lexicon:
    """Learn from at most about ``at_most`` labelled rows, none of them held out. The lexicon has at most ``size`` words."""
    spark = docs.sparkSession
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    own = own.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    few = sampled(own, "id", at_most)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if n > at_most:  # the same draw keeps other texts out of the join
        texts = texts.filter(chance(F.col("id")) < at_most / n)
    rows = spill(texts.join(few, "id").select("text", "toxic"), "toxicity-rows")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    seen = rows.mapInPandas(_occurrences, "word string, before string, after string, toxic int").groupBy("word", "before", "after").agg(F.max("toxic").alias("toxic"))
    seen = spill(seen, "toxicity-words")
    counts = spill(seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-counts")
    least_g = 2 * float(np.log(max(2, counts.count())))  # chance alone brings about one word of all so far
    p, q = bad / (bad + good), good / (bad + good)
    n_word = F.col("t") + F.col("c")
    g = 2 * (F.col("t") * F.log(F.col("t") / (n_word * p)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n_word * q))).otherwise(0.0))
    weight = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("c") + 0.5) / (good + 1.0))
    top = counts.filter("t > 0").withColumns({"g": g, "weight": weight}).filter((F.col("g") >= least_g) & (F.col("weight") >= LEAST_WEIGHT))
    found = top.orderBy(F.desc("g"), "word").limit(size).collect()
    lexicon = Lexicon({r["word"]: min(float(r["weight"]), MOST_WEIGHT) for r in found})
    if not found:
        return lexicon
    kept = spark.createDataFrame([(r["word"],) for r in found], "word string")
    near = seen.join(F.broadcast(kept), "word")
    pairs = near.select(F.explode(F.array(F.struct(F.concat_ws(" ", "before", "word").alias("phrase"), "word", "toxic"), F.struct(F.concat_ws(" ", "word", "after").alias("phrase"), "word", "toxic"))).alias("x"))
    common = pairs.groupBy("x.phrase", "x.word").agg(F.sum("x.toxic").alias("t"), F.sum(1 - F.col("x.toxic")).alias("c")).filter((F.col("c") >= EXCEPTION_SUPPORT) & (F.col("t") * good <= F.col("c") * bad))
    for r in common.orderBy(F.desc("c"), "phrase").limit(size).collect():
        lexicon.exceptions.setdefault(r["phrase"].strip(), []).append(r["word"])
    for phrase in EXCEPTIONS:
        lexicon.exceptions.setdefault(phrase, phrase.split())
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("a double, b double")
    def measured(column: pd.Series) -> pd.DataFrame:
        automaton = shared.value.automaton()
        return pd.DataFrame([shared.value.features(t, automaton) for t in column], columns=["a", "b"])

    table = rows.select(measured("text").alias("x"), "toxic").select("x.a", "x.b", "toxic").toPandas()
    a, b, y = table["a"].to_numpy(), table["b"].to_numpy(), table["toxic"].to_numpy(float)
    lexicon.curve = fit_curve(a, b, y)
    lexicon.curve = shifted(lexicon.curve, lexicon.score(a, b), y)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score of ``text_col`` in the column ``out``, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for column in columns:
            pairs = np.array([lexicon.features(t, automaton) for t in column]).reshape(-1, 2)
            yield pd.Series(lexicon.score(pairs[:, 0], pairs[:, 1]))

    return docs.withColumn(out, scored(F.col(f"`{text_col}`")))
