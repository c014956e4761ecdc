"""Exact similarity search with the filter applied before ranking, and the experiments built on it.

Queries and corpus are dealt to the cells of a grid, query blocks by corpus blocks, in one shuffle, whatever their numbers. A cell is one matrix product in single precision, taken ``SLICE``
queries at a time, which leaves the rows that can be among the best k within its error; these alone are computed in double precision. Only the best k per query leave a cell, and the best of all cells are
ranked by a window that keeps k rows per query before its shuffle. Nothing of queries or corpus passes through the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.vectors import unscoped

#: A row of the corpus is sent once for each block of queries, a query once for each block of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 16_384, 16_384
#: Below this many rows a corpus block isn't cut further to give every core a cell.
LEAST_BLOCK = 512
SLICE = 256  # queries multiplied with a block at once
GROUPS = 256  # of rows of a block; their greatest similarities bound the k-th best of all
PAIRS = 4096  # computed in double precision at once
DIGITS = 6  # similarities are ranked as rounded, ties by id, so that any engine finds the same rows

FOUND = "query_id long, id long, sim double, applies_to array<string>"
_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("sim", pa.float64()), ("applies_to", pa.list_(pa.string()))])


def topk(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, sim, applies_to): the k most similar rows of ``corpus`` (id, embedding, applies_to) for each row of ``queries``.

    ``queries`` has query_id, embedding and classes: null or empty asks without a filter, else only rows that bind one of the classes, or
    none at all, are eligible. Fewer eligible rows give fewer results; k of 0 or less gives none. Rows without a vector are left out on either side.
    """
    rows, asked = searchable(corpus), askable(queries)
    n_rows, n_asked = corpus.count(), queries.count()  # with those without a vector: the vectors need not be read for it
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    across, down = blocks(n_asked, QUERY_BLOCK), max(blocks(n_rows, CORPUS_BLOCK), min(2 * cores, blocks(n_rows, LEAST_BLOCK)))
    left = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("_c", dealt(F.col("id"), F.lit(down)))
    right = asked.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_q", dealt(F.col("query_id"), F.lit(across)))

    def cell(corpus: pa.Table, asked: pa.Table) -> pa.Table:
        parts = list(best_of(corpus, asked, k, exclude_self))
        return pa.concat_tables(parts) if parts else _FOUND.empty_table()

    return ranked(left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(cell, FOUND), k)


def searchable(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("id").cast("long").alias("id"), "embedding", F.coalesce("applies_to", F.array().cast("array<string>")).alias("applies_to")).filter(F.col("embedding").isNotNull())


def askable(queries: DataFrame) -> DataFrame:
    """(query_id, wanted, classes). No column is named as one of the corpus: queries are often rows of it, and the two sides of a cogroup mustn't share columns."""
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("wanted"), "classes").filter(F.col("wanted").isNotNull())


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("grid")), parts).cast("int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, id, sim, ...) per query, with their rank."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "sim", "applies_to")


def matrix(table: pa.Table, column: str = "embedding", kind: type | None = np.float64) -> np.ndarray:
    """A column of equally long vectors as a matrix, of its own kind of numbers if ``kind`` is None."""
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    flat = flat if kind is None else flat.astype(kind, copy=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), flat.dtype)


def fitting(rows: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray | None]]:
    """For each query which rows it may have: None for all."""
    classes = [frozenset(c or ()) for c in asked["classes"].to_pylist()]
    bound = [frozenset(a or ()) for a in rows["applies_to"].to_pylist()] if any(classes) else []
    fits = {c: np.fromiter((not b or not b.isdisjoint(c) for b in bound), bool, len(bound)) for c in set(classes) if c}
    return ((at, fits.get(c)) for at, c in enumerate(classes))


def chosen(sims: np.ndarray, fit: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k greatest of each column of ``sims`` among those that fit, ties by id."""
    if len(own) > k:
        sims = np.where(fit, sims, -np.inf)
        fit = fit & (sims >= np.partition(sims, len(own) - k, axis=0)[len(own) - k])
    row, q = np.nonzero(fit)
    order = np.lexsort((own[row], -sims[row, q], q))
    row, q = row[order], q[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return row[first], q[first]


def likely(sims: np.ndarray, margin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all that is at most ``margin`` below the k-th greatest of its row of ``sims``, and of some more; -inf is never among them."""
    n = sims.shape[1]
    parts = max(GROUPS, 4 * k)
    floor = np.full(len(sims), -np.inf)
    if n >= parts:  # k groups of rows have a greatest that isn't below the k-th of these: as many rows are as good
        tops = np.fmax.reduce(sims[:, : n // parts * parts].reshape(len(sims), -1, parts), axis=1)
        floor = np.partition(np.where(np.isnan(tops), -np.inf, tops), parts - k, axis=1)[:, parts - k].astype(np.float64)
    floor = np.maximum(floor - margin, np.finfo(sims.dtype).min).astype(sims.dtype)
    found = np.flatnonzero(sims >= floor[:, None])
    return found // n, found % n


def products(rows: np.ndarray, wanted: np.ndarray, row: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The similarities of pairs in double precision, from a product of matrices where the pairs are many, as with copies."""
    if len(q) > 4 * PAIRS:
        some, at = np.unique(row, return_inverse=True)
        return (rows[some].astype(np.float64) @ wanted.astype(np.float64).T)[at, q]
    sims = np.empty(len(q))
    for i in range(0, len(q), PAIRS):
        part = slice(i, i + PAIRS)
        sims[part] = np.einsum("ij,ij->i", rows[row[part]].astype(np.float64), wanted[q[part]].astype(np.float64))
    return sims


def longest(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the rows; what isn't finite counts as 0."""
    squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    return np.sqrt(np.where(np.isfinite(squares), squares, 0.0))


def best_of(rows: pa.Table, asked: pa.Table, k: int, exclude_self: bool) -> Iterator[pa.Table]:
    """The best k rows of a block for each query of a block."""
    if not rows.num_rows or not asked.num_rows or k <= 0:
        return
    own, names, vectors, wanted = rows["id"].to_numpy(), asked["query_id"].to_numpy(), matrix(rows, kind=None), matrix(asked, "wanted", None)
    size = longest(vectors).max() * longest(wanted)
    fast, bits = (np.float32, 24) if size.max() < 1e12 and np.abs(vectors).max() < 1e12 and np.abs(wanted).max() < 1e12 else (np.float64, 53)
    left, right = vectors.astype(fast, copy=False), wanted.astype(fast, copy=False)
    # by how much numbers of so many bits (the input among them) and the rounding of ranks can move two similarities
    margin = 2 * (vectors.shape[1] + 4) * 2.0**-bits * size + 2 * 10.0**-DIGITS
    fits = dict(fitting(rows, asked))
    for at in range(0, len(names), SLICE):
        part = slice(at, at + SLICE)
        sims = right[part] @ left.T
        for q in range(len(sims)):
            if fits[at + q] is not None:
                sims[q, ~fits[at + q]] = -np.inf
        if exclude_self:
            sims[names[part, None] == own] = -np.inf
        q, row = likely(sims, margin[part], k)
        sims = np.round(products(vectors, wanted[part], row, q), DIGITS)
        order = np.lexsort((own[row], -sims, q))
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]  # q was in order before
        q, row, sims = q[order], row[order], sims[order]
        yield pa.table({"query_id": names[at + q], "id": own[row], "sim": sims, "applies_to": rows["applies_to"].take(pa.array(row))}, schema=_FOUND)


def precision(results: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits, returned rows and their share per query, and a total (query_id null). ``asked`` has query_id and class; rows that bind no class are misses."""
    hit = F.coalesce(F.array_contains("applies_to", F.col("class")), F.lit(False)).cast("int")
    return (
        results.join(asked.select("query_id", "class"), "query_id").withColumn("hit", hit).rollup("query_id")
        .agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.count("*").alias("returned"))
        .withColumn("precision", F.col("hits") / F.greatest("returned", F.lit(1)))
    )


def probe(corpus: DataFrame, seeds: int = 6, k: int = 5, seed: int = 0) -> DataFrame:
    """Neighbours of a few rows drawn by a hash of their ids, without the rows themselves."""
    drawn = corpus.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(seeds)
    return topk(corpus, drawn.select(F.col("id").alias("query_id"), "embedding", F.lit(None).cast("array<string>").alias("classes")), k, exclude_self=True)


def worked_example(results: DataFrame, asked: DataFrame) -> DataFrame:
    """Ranked rows with OK where they bind the class asked about, else --."""
    flag = F.when(F.array_contains("applies_to", F.col("class")), "OK").otherwise("--")
    return results.join(asked.select("query_id", "class"), "query_id").withColumn("flag", flag)


def pairing_mismatches(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: chunks without a vector, vectors without a chunk."""
    both = chunks.select(key, F.lit(1).alias("c")).join(vectors.select(key, F.lit(1).alias("v")), key, "full")
    return both.agg(F.count_if(F.col("v").isNull()).alias("chunks_alone"), F.count_if(F.col("c").isNull()).alias("vectors_alone"))
