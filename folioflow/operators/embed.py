"""Embedding behind an interface, with a deterministic encoder that needs no model files."""

from __future__ import annotations

from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.dictionaries import QUERY_PREFIX

DIM = 384
SLICE = 512  # texts hashed at once
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one row a text."""


class HashingEmbedder:
    """Words and word pairs hashed to signed places; counts are damped, vectors have length one."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [self._encode(texts[at : at + SLICE]) for at in range(0, len(texts), SLICE)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim), np.float32)

    def _encode(self, texts: list[str]) -> np.ndarray:
        tokens = [(text or "").lower().split() for text in texts]
        words = np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(tokens)), np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
        words, row = words[words > 0], row[words > 0]
        inside = row[:-1] == row[1:]  # a pair is of one text
        terms = np.concatenate([words, ((words[:-1] * PAIR + words[1:]) * PAIR)[inside]])
        place = np.concatenate([row, row[:-1][inside]]) * self.dim + (terms % np.uint64(self.dim)).astype(np.int64)
        out = np.bincount(place, np.where(terms >> np.uint64(63), 1.0, -1.0), len(texts) * self.dim).reshape(len(texts), self.dim)
        out = np.sign(out) * np.sqrt(np.abs(out))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1.0)).astype(np.float32)


class _Terms(dict):
    """The hash of each word without punctuation around it and without a plural s; 0 where nothing is left. It is emptied when it is large."""

    def __missing__(self, token: str) -> int:
        word = token.strip(".,;:()[]\"'?!")
        word = word[:-1] if len(word) > 3 and word.endswith("s") else word
        if len(self) >= 200_000:
            self.clear()
        self[token] = h = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        return h


_KNOWN = _Terms()


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """``rows`` with the vector of a passage; passages go in as they are."""

    @F.arrow_udf("array<float>")
    def encoded(texts: pa.Array) -> pa.Array:
        vectors = np.asarray(embedder.encode([t or "" for t in texts.to_pylist()]), np.float32)
        starts = np.arange(0, vectors.size + 1, embedder.dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(vectors.ravel()))

    return rows.withColumn(out, encoded(F.col(text_col)))


def embed_queries(rows: DataFrame, embedder: Embedder, text_col: str = "question", out: str = "embedding") -> DataFrame:
    """``rows`` with the vector of a query; queries get an instruction in front."""
    return embed(rows.withColumn("_asked", F.concat(F.lit(QUERY_PREFIX), F.col(text_col))), embedder, "_asked", out).drop("_asked")
