"""Language identification by interpolated Kneser-Ney character models.

For each language a model of ``ORDER`` characters is learned from a bounded sample of labelled rows: of the ``LANGUAGES`` most frequent languages about
``PER_LANGUAGE`` documents and ``CHARACTERS`` characters each, the first quarter of them kept for calibration. The grams of all languages lie in one sorted array
of hashes per length, with a row of log-probabilities, one per language, in which the interpolation is already done; a gram that isn't listed falls back to the
weight of its history and the next shorter gram. A text is scored whole. Its language is the one with the lowest cross-entropy
per character; the score is its share under a softmax of the cross-entropies.

Rejection is calibrated on the texts that the models haven't seen. The deviation of a text is how far its cross-entropy lies above the
median of its language, over what chance allows a text of its length (``SLACK`` of the median, and the noise of its characters). A
text is rejected if it deviates more than ``REACH`` times as far as the ``QUANTILE`` of the calibration texts. Null texts and texts without a letter
are ``und`` with score 0 and rejected; an empty training set makes every text so. Case is folded; whatever isn't a letter is one gap. Ties go to the first language by name.
Rows are independent: repeated rows and null ids need no rule, and other columns, whatever their names, pass through, but for those that the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.training import chance, held_out

ORDER = 4
PER_LANGUAGE, CHARACTERS, LANGUAGES = 600, 4_000_000, 100
QUANTILE, REACH = 0.995, 1.5
SLACK = 0.1
SHARPNESS = 12.0
GAP = 32
U = np.uint64
PRIME = U(0x9E3779B97F4A7C15)
STEP = 1 << 20  # characters scored at once

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def fold(text: str | None) -> np.ndarray:
    """The letters of a text in lower case, words between single gaps; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, codes, np.uint32(GAP))[keep]
    return np.concatenate([[np.uint32(GAP)], out]) if out[0] != GAP else out


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive characters."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, U)
    out = np.full(size, U(n), U)
    for i in range(n):
        out = (out + codes[i : i + size].astype(U)) * PRIME
        out ^= out >> U(31)
    return out


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted ``keys``, -1 where a hash isn't listed."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """keys[n], probs[n]: grams of n + 1 characters and their log2 probability per language; histories likewise with their back-off weights."""

    languages: list[str]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    histories: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    middle: np.ndarray
    noise: np.ndarray
    limit: float = np.inf

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Log2 probability of each character after the first, per language."""
        out = np.empty((max(0, len(codes) - 1), len(self.languages)), np.float32)
        for i in range(0, len(out), STEP):
            lead = min(i, ORDER - 2)
            part = codes[i - lead : i + STEP + 1]
            out[i : i + STEP] = self._bits(part)[lead:]
        return out

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        count = len(codes) - 1
        total = np.zeros((count, len(self.languages)), np.float32)
        left = np.arange(count)  # characters, by the place of the one before, still without a gram
        for n in range(ORDER, 0, -1):
            room = left + 2 - n >= 0
            at = np.full(len(left), -1)
            begin = left[room] + 2 - n
            at[room] = lookup(self.keys[n - 1], grams(codes, n)[begin] if len(begin) else np.empty(0, U))
            found = at >= 0
            total[left[found]] += self.probs[n - 1][at[found]]
            if n > 1:
                miss = ~found & room
                h = lookup(self.histories[n - 1], grams(codes, n - 1)[left[miss] + 2 - n])
                known = h >= 0
                total[left[miss][known]] += self.weights[n - 1][h[known]]
            left = left[~found]
        total[left] += self.floor
        return total

    def judge(self, text: str | None) -> tuple[str, float, bool, float]:
        """(language, score, rejected, cross-entropy)."""
        codes = fold(text)
        if len(codes) < 2 or not self.languages:
            return "und", 0.0, True, 0.0
        n = len(codes) - 1
        entropy = -self.bits(codes).sum(axis=0, dtype=np.float64) / n
        best = int(np.argmin(entropy))
        share = 1.0 / np.exp2(-SHARPNESS * (entropy - entropy[best])).sum()
        return self.languages[best], float(share), bool(self.deviation(entropy[best], best, n) > self.limit), float(entropy[best])

    def deviation(self, entropy: float, language: int, n: int) -> float:
        """How far a text of n characters lies above the median of a language, in units of what chance allows."""
        chance = np.hypot(SLACK * self.middle[language], self.noise[language] / np.sqrt(n))
        return float((entropy - self.middle[language]) / chance) if chance > 0 else 0.0


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    texts = {lang: [c for c in (fold(t) for t, own in rows if own == lang) if len(c)] for lang in languages}
    languages = [lang for lang in languages if texts[lang]]
    kept = {lang: max(1, len(texts[lang]) // 4) if len(texts[lang]) > 1 else 0 for lang in languages}
    wide = len(languages)
    counted = []  # per language, per length: grams, counts, and the hashes of history and of the shorter gram
    for lang in languages:
        own = []
        for n in range(1, ORDER + 1):
            parts = [(grams(c, n), grams(c, n - 1)[: len(c) - n + 1], grams(c, n - 1)[1:]) if n > 1 else (grams(c, 1),) * 3 for c in texts[lang][kept[lang] :]]
            g, h, s = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, U) for i in range(3))
            keys, first, count = np.unique(g, return_index=True, return_counts=True)
            own.append([keys, count.astype(np.float64), h[first], s[first]])
        for n in range(1, ORDER):  # shorter grams count what they follow, not how often
            shorter, spread = np.unique(own[n][3], return_counts=True)
            at = lookup(shorter, own[n - 1][0])
            own[n - 1][1] = np.where(at >= 0, spread[np.maximum(at, 0)], 1).astype(np.float64) if len(shorter) else own[n - 1][1]
        counted.append(own)
    keys, probs, histories, weights = [], [], [np.empty(0, U)], [np.zeros((0, wide), np.float32)]
    alphabet = len(np.unique(np.concatenate([o[0][0] for o in counted]))) + 1 if counted else 1
    floor = np.full(wide, -np.log2(alphabet + 1), np.float64)
    lower = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([o[n - 1][0] for o in counted])) if counted else np.empty(0, U)
        heads = np.zeros(len(union), U)
        tails = np.zeros(len(union), U)
        for o in counted:
            at = lookup(union, o[n - 1][0])
            heads[at], tails[at] = o[n - 1][2], o[n - 1][3]
        p = np.zeros((len(union), wide))
        if n > 1:
            histories.append(np.unique(heads))
            weights.append(np.zeros((len(histories[-1]), wide)))
        for i, o in enumerate(counted):
            g, c, h, _ = o[n - 1]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = lookup(union, g)
            if n == 1:
                total = max(c.sum(), 1.0)
                base = np.full(len(union), 1.0 / (alphabet + 1))
                p[:, i] = d * len(g) / total * base
                p[at, i] += np.maximum(c - d, 0) / total
                floor[i] = np.log2(max(d * len(g) / total / (alphabet + 1), 1e-9))
                continue
            of, kinds = np.unique(h, return_inverse=True)
            total, seen = np.bincount(kinds, c), np.bincount(kinds)
            lam = np.ones(len(histories[-1]))
            lam[lookup(histories[-1], of)] = d * seen / total
            weights[-1][:, i] = np.log2(lam)
            below = np.exp2(lower[1][lookup(lower[0], tails), i])
            p[:, i] = lam[lookup(histories[-1], heads)] * below
            p[at, i] += np.maximum(c - d, 0) / total[kinds]
        lower = (union, np.log2(np.maximum(p, 1e-12)))
        keys.append(union)
        probs.append(lower[1].astype(np.float32))
    model = Model(languages, keys, probs, histories, [w.astype(np.float32) for w in weights], floor.astype(np.float32), np.zeros(wide), np.zeros(wide))
    unseen = [[c for c in (texts[lang][: kept[lang]] or texts[lang]) if len(c) > 1] for lang in languages]
    for i, own in enumerate(unseen):
        each = [-model.bits(c)[:, i].astype(np.float64) for c in own]
        if each:
            model.middle[i], model.noise[i] = np.median([b.mean() for b in each]), np.median([b.std() for b in each])
    found = []
    for c in (c for own in unseen for c in own):
        entropy = -model.bits(c).sum(axis=0, dtype=np.float64) / (len(c) - 1)
        best = int(np.argmin(entropy))
        found.append(model.deviation(entropy[best], best, len(c) - 1))
    if found:
        model.limit = REACH * max(1.0, float(np.quantile(found, QUANTILE)))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of each language, the same in every run; none of the rows is held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    size = F.char_length("text")
    rows = rows.filter(~held_out(F.col("id")) & (size <= CHARACTERS))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("chars")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"), F.lit(float(CHARACTERS)) / F.greatest("chars", F.lit(1)))
    shares = counts.select("lang", share.alias("share"))  # at most LANGUAGES rows
    found = rows.join(F.broadcast(shares), "lang").filter(chance(F.col("id")) < F.col("share")).select("id", "text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], str(r["id"]), r["text"]))])


JUDGED = "lang_pred string, lang_score double, lang_rejected boolean, lang_entropy double"


def _judged(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(doc, judged): the columns of ``docs`` as a struct, and what the model says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(JUDGED)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in texts:
            yield pd.DataFrame([shared.value.judge(t) for t in column], columns=["lang_pred", "lang_score", "lang_rejected", "lang_entropy"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return packed.select("doc", judge(F.col(f"doc.`{text_col}`")).alias("judged"))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_rejected and lang_entropy, which replace columns of those names."""
    new = ["lang_pred", "lang_score", "lang_rejected", "lang_entropy"]
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in new]
    return _judged(docs, model, text_col).select(*kept, *[F.col(f"judged.{c}") for c in new])


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their own columns."""
    return _judged(docs, model, text_col).filter("NOT judged.lang_rejected").select("doc.*")
