"""Hashes of words, shingles and windows in numpy, for operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

U = np.uint64
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordHashes(dict):
    """64-bit hashes of words; the cache is emptied when it holds ``most`` of them."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8. Bytes split at, and lower-case, ASCII alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= _ODD[0]
    x ^= x >> U(29)
    x *= _ODD[1]
    x ^= x >> U(32)
    return x


def rolled(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive entries of ``h``; none where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, U(seed * 2 + 1), U)
    factor = _ODD[2] + U(2 * seed)
    for i in range(k):
        out *= factor
        out += h[i : i + n]
    return mix(out)


def shingles(words: list[bytes], k: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct k-word shingles; the whole sequence where there are fewer words; none without words."""
    h = cache.of(words)
    return np.unique(rolled(h, k if len(h) >= k else max(1, len(h)), k if len(h) >= k else len(h)))


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in a stream of frames sorted by them, one frame a run."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        cols = [frame[k].to_numpy() for k in keys]
        new = np.zeros(len(frame), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
