"""Mixing sources to target weights by systematic sampling.

The sources, sorted by code point with null last, take the weights in turn and share the words of all documents by
them. No target exceeds ``cap`` times its source's words; what a capped source can't take is shared again by weight.
Within a source every document is expected ``target / source words`` times. Documents are put in order of size, the
expected copies are summed along that order, one random offset per source is added, and a document is emitted once per
integer boundary that its stretch of the sum crosses. The order by size bounds the error: the words taken differ from
the target by no more than about the largest document, and no document is taken more than ``ceil(cap)`` times.

The prefix sum is distributed: each size is cut into about sqrt(rows) slices by a hash of the id, slices are counted,
starts are summed over the counts, and only inside a slice are rows numbered. A hot source or size is so split. Documents move once, to
their slices; starts and targets come to them there. Only the sources, one row each, meet in one task.

Null texts and texts without words have size 0 and are taken 0 words; null ids and repeated rows count as rows of their own.
A table without rows or words gives targets of 0. Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.words import word_count
from folioflow.plans.materialize import spill

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per source of (source, size): source_size, weight, target, rate (copies of each document), offset in [0, 1).

    The level of the targets is found without a loop: in order of cap to weight, a source is capped if its cap is below
    what the words not yet capped give it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, all_rows = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    levels = (
        totals.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn])
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(all_rows)["level"])
    )
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    return levels.select(
        "source", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("offset"),
    )


def _key(source: Column) -> Column:
    """A source as a key that is never null, so that joins can use the partitioning of windows."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _numbered(rows: DataFrame, sizes: DataFrame, targets: DataFrame, n_rows: int, tie: list[Column]) -> DataFrame:
    """``rows`` with ``targets`` of their source and ``rank``: the place of each among the rows of its source by size, slice and tie.

    ``rows`` and ``sizes`` have id, key, size; ``targets`` has key.
    """
    slices = max(1, math.isqrt(n_rows))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    sliced = lambda df: df.withColumn("slice", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slices)
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    per_size = sizes.groupBy("key", "size").count()
    size_start = per_size.select("key", "size", F.coalesce(F.sum("count").over(before("key", "size")), F.lit(0)).alias("size_start"))
    per_slice = sliced(sizes).groupBy("key", "size", "slice").count()
    per_slice = per_slice.select("key", "size", "slice", F.coalesce(F.sum("count").over(before("key", "size", "slice")), F.lit(0)).alias("slice_start"))
    starts = per_slice.join(size_start, ["key", "size"]).join(targets, "key")
    placed = sliced(rows).withColumn("place", F.row_number().over(W.partitionBy("key", "size", "slice").orderBy(*tie)))
    return placed.join(starts, ["key", "size", "slice"]).withColumn("rank", F.col("size_start") + F.col("slice_start") + F.col("place"))


def copies(rate: Column, offset: Column, rank: Column, cap: float) -> Column:
    """Integer boundaries crossed between the sums before and after a document: no more than ``ceil(cap)``, whatever the rounding."""
    step = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return F.least(step, F.lit(math.ceil(cap)).cast("long"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, cap: float = CAP, seed: str = SEED, carry: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies; with ``carry`` also ``doc``, its columns as a struct.

    Texts are read once for their sizes, which are written to the shared folder; with ``carry`` a second time, and each document moves once.
    """
    source = F.col(f"`{source_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"), source.alias("source"), _key(source).alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
    )
    thin = spill(base.select("id", "source", "key", "size"), "mixing")
    targets = source_targets(thin, weights, cap, seed).select(_key(F.col("source")).alias("key"), "source_size", "target", "rate", "offset")
    numbered = _numbered(base if carry else thin, thin, targets, thin.count(), [F.col("id").asc_nulls_last()])
    return numbered.select(
        "id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("offset"), F.col("rank"), cap).alias("copies"), *(["doc"] if carry else [])
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a document taken n times is n rows."""
    return (
        mix_plan(docs, carry=True, **options).filter("copies > 0")
        .select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
    )
