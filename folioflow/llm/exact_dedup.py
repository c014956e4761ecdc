"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows meet in a shuffle.

Pass one counts, in a filter of bounded size, the bits that two or more text hashes set. Pass two probes it: a row
whose bits were set once is unique and passes straight through. The rest are grouped by SHA-256, so a false positive
of the filter costs work and never changes a result. Hashes are dealt to ranges with a filter of bounded size each, so the filters keep
their effect up to ``bitfilter.MAX_RANGES`` times ``max_bits``; beyond that more thin rows meet in the shuffle. What pass one shuffles is two numbers
a row: filters that each task fills and a bit_or merges would send tasks times filters, which is more from eight tasks on. Groups are
pre-aggregated before their shuffle, written, and joined back to their rows by a sort-merge join whose hot keys adaptive execution splits.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
largest id stays; a null id is the smallest; of rows with equal text and id, one stays. An empty table gives an
empty result. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.words import ascii_lower
from folioflow.llm import bitfilter
from folioflow.plans.materialize import spill


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. Texts are read once and never shuffled."""
    thin = spill(
        docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "exact-dedup",
    )
    probed = bitfilter.maybe_repeated(thin, "sha", thin.count(), max_bits)
    once = probed.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    again = probed.filter("maybe").select("id", "sha", "row")
    groups = spill(again.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")), "exact-groups")
    met = again.join(groups, "sha").select(
        "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "sha"
    )
    return once.unionByName(met).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows with a text of their own don't shuffle.

    The thin pass finds the hashes that do repeat; documents meet only those.
    """
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    hashed = hashed.select("doc", F.col(f"doc.`{id_col}`").alias("id"), text_hash(F.col(f"doc.`{text_col}`")).alias("sha"))
    thin = spill(hashed.select("id", "sha"), "exact-dedup")
    again = bitfilter.maybe_repeated(thin, "sha", thin.count(), max_bits).filter("maybe")
    last = again.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    last = spill(last.select(F.col("sha").alias("key"), "last"), "exact-groups")
    bits = bitfilter.bits_for(last.count(), max_bits)
    probed = bitfilter.probe(hashed, bitfilter.present(last.select("key"), bits), F.col("sha"), bits, "maybe")
    met = probed.filter("maybe").join(last, F.col("sha") == F.col("key"), "left")
    one = met.filter(F.col("key").isNotNull() & F.col("id").eqNullSafe(F.col("last"))).groupBy("sha").agg(F.first("doc").alias("doc"))
    alone = probed.filter("NOT maybe").select("doc").unionByName(met.filter("key IS NULL").select("doc"))
    return alone.unionByName(one.select("doc")).select("doc.*")
