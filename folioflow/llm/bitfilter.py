"""Bloom filters made and probed with DataFrame operations alone.

A filter is a table of (chunk, words): 64 longs a row, 4,096 bits. Its size is at most ``bits / 8`` bytes, whatever
the data, so it may be broadcast. A filter that is too full only lets more rows through: callers check those exactly. Keys too many for
one filter are dealt to ranges of their hash, each with a filter of its own that is made and probed with the keys of that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.materialize import spill

MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
MAX_RANGES = 64
BITS_A_ROW = 16


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two of about 16 bits a row, at most ``max_bits``."""
    bits = min(MIN_BITS, max_bits)
    while bits < min(max_bits, BITS_A_ROW * rows):
        bits *= 2
    return bits


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits that a key sets, as an array."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def build(at: DataFrame) -> DataFrame:
    """The filter in which the bits named by the single column of ``at`` are set."""
    (pos,) = at.columns
    words = at.groupBy(F.shiftright(pos, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(pos).bitwiseAND(63)).cast("int"))).alias("mask")
    )
    return (
        words.groupBy(F.shiftright("word", 6).alias("chunk"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(63).cast("int"), "mask"))).alias("m"))
        .select("chunk", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("words"))
    )


def repeated(keys: DataFrame, bits: int, hashes: int = 2) -> DataFrame:
    """The filter of bits that two or more rows of the single column of ``keys`` set: pass one of two."""
    (key,) = keys.columns
    counted = keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("pos")).groupBy("pos").count()
    return build(counted.filter("count > 1").select("pos"))


def present(keys: DataFrame, bits: int, hashes: int = 2) -> DataFrame:
    """The plain filter of the keys in the single column of ``keys``."""
    (key,) = keys.columns
    return build(keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("pos")))


def probe(df: DataFrame, bloom: DataFrame, key: Column, bits: int, out: str, hashes: int = 2) -> DataFrame:
    """``df`` with the boolean column ``out``: false where the filter rules the key out."""
    kept, found = df.columns, F.lit(True)
    for i in range(hashes):
        side = F.broadcast(bloom.select(F.col("chunk").alias(f"_chunk{i}"), F.col("words").alias(f"_words{i}")))
        df = df.withColumn(f"_pos{i}", F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)))
        df = df.join(side, F.shiftright(f"_pos{i}", 12) == F.col(f"_chunk{i}"), "left")
        word = F.get(F.col(f"_words{i}"), F.shiftright(f"_pos{i}", 6).bitwiseAND(63).cast("int"))
        bit = F.call_function("shiftright", word, F.col(f"_pos{i}").bitwiseAND(63).cast("int")).bitwiseAND(1)
        found = found & (F.coalesce(bit, F.lit(0)) == 1)
    return df.withColumn(out, found).select(*kept, out)


def ranges_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """How many filters of ``max_bits`` hold so many keys, up to MAX_RANGES."""
    return max(1, min(MAX_RANGES, -(-BITS_A_ROW * rows // max_bits)))


def maybe_repeated(thin: DataFrame, key: str, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``thin``, a written table, with the boolean column ``maybe``: false for rows whose key no other row has.

    One range after the other: only one filter is broadcast at a time.
    """
    ranges = ranges_for(rows, max_bits)
    bits = bits_for(-(-rows // ranges), max_bits)
    if ranges == 1:
        return probe(thin, repeated(thin.select(key), bits), F.col(key), bits, "maybe")
    dealt = F.pmod(F.xxhash64(F.col(key), F.lit("range")), F.lit(ranges))
    out = None
    for r in range(ranges):
        part = thin.filter(dealt == r)
        probed = spill(probe(part, repeated(part.select(key), bits), F.col(key), bits, "maybe"), "range")
        out = probed if out is None else out.unionByName(probed)
    return out
