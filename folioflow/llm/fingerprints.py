"""Document fingerprints by order MinHash, with built-in functions alone.

The k-mers of a text are ``K`` consecutive words, numbered by occurrence: the second time a k-mer appears it is another
element. Elements are hashed once, and the hash deals them to ``SLOTS`` slots (one permutation for all slots). Each slot selects its ``PICK`` smallest
elements, puts them back in the order of the text, and hashes the tuple to 16 bits. Moving a passage changes tuples though it
changes no k-mer, so likeness follows edit distance. A slot without elements is 0; the likeness of two
fingerprints is the share of equal slots among those that either fills.

A text with fewer words than K is one k-mer; a text without words (null too) has the fingerprint of zeros, and two such texts have likeness 1. Equal
texts have equal fingerprints. Per document the work is two sorts of longs, each of 43 bits of hash and 21 bits of place; a text with more places than that sorts pairs of the
same hash and the whole place. Nothing is sampled: every word of a text enters.

``neighbours`` ties each id to the next larger one without a global sort in one task: ids are dealt to blocks
between approximate quantiles, neighbours are found within blocks, and block ends are tied through one row per block. The
number of blocks is bounded by ``MAX_BLOCKS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.words import words
from folioflow.plans.materialize import spill

K, SLOTS, PICK = 2, 64, 2
PLACE_BITS = 21
PLACE = (1 << PLACE_BITS) - 1
HASH = ~PLACE
SLOT_SHIFT = 58
BLOCK_ROWS = 20_000
MAX_BLOCKS = 4096
EMPTY = "0" * 4 * SLOTS


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _run_starts(sorted_: Column, part) -> Column:
    """Where ``part`` of a sorted array changes."""
    return F.filter(_places(F.size(sorted_)), lambda i: (i == 0) | (part(F.get(sorted_, i)) != part(F.get(sorted_, i - 1))))


def fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` (16 bits a slot) in the binary column ``out``, which replaces one of that name.

    Each step is a column that the next one reads more than once, or outside functions of elements: else the optimizer would
    move it into such a function and compute it once per element.
    """
    names = [c for c in df.columns if c.lower() != out.lower()]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), words(text).alias("_w"))
    n, w = F.size("_w"), F.col("_w")
    kmers = F.when(n >= K, n - K + 1).otherwise(F.least(n, F.lit(1)))
    kmer = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)])
    wide = kmers > PLACE + 1
    for way, count in ((_PACKED, F.when(~wide, kmers)), (_WIDE, F.when(wide, kmers))):
        df = way.elements(df, F.coalesce(count, F.lit(0)), kmer)
    filled = F.when(wide, _WIDE.slots()).otherwise(_PACKED.slots())
    return df.select(*[F.col(f"doc.`{c}`") for c in names], F.unhex(filled).alias(out))


class _Packed:
    """Elements as longs: hash above, place below."""

    name = "p"

    def placed(self, h: Column, i: Column) -> Column:
        return h.bitwiseAND(F.lit(HASH)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE)))

    def hash_of(self, x: Column) -> Column:
        return x.bitwiseAND(F.lit(HASH))

    def place_of(self, x: Column) -> Column:
        return x.bitwiseAND(F.lit(PLACE))

    def in_text_order(self, mine: Column) -> Column:
        turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS))
        order = F.sort_array(F.transform(mine, turned))  # by place, then hash
        return F.transform(order, lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1)))

    def elements(self, df: DataFrame, count: Column, kmer) -> DataFrame:
        """``df`` with the elements in order of hash, and where each slot begins in them."""
        k, r, e, s = (f"_{c}{self.name}" for c in "kres")
        df = df.withColumn(k, F.sort_array(F.transform(_places(count), lambda i: self.placed(kmer(i), i))))
        df = df.withColumn(r, _run_starts(F.col(k), self.hash_of))
        occurrence = F.flatten(F.transform(r, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(r, j + 1), F.size(k)) - at - 1)))
        element = lambda x, o: self.placed(F.xxhash64(self.hash_of(x), F.coalesce(o, F.lit(0))), self.place_of(x))
        df = df.withColumn(e, F.sort_array(F.zip_with(k, occurrence, element)))
        return df.withColumn(s, _run_starts(F.col(e), self.slot))

    def slot(self, x: Column) -> Column:
        return F.shiftrightunsigned(x, SLOT_SHIFT)

    def slots(self) -> Column:
        """The 64 slots in hexadecimal."""
        e, s = f"_e{self.name}", f"_s{self.name}"

        def tuple_of(at: Column) -> Column:
            """The slot's elements in text order, hashed."""
            mine = F.filter(F.slice(e, at + 1, PICK), lambda x: self.slot(x) == self.slot(F.get(e, at)))
            return F.xxhash64(self.in_text_order(mine)).bitwiseAND(F.lit(0xFFFF))

        entries = F.transform(s, lambda at: F.struct(self.slot(F.get(e, at)).cast("int").alias("k"), F.greatest(tuple_of(at), F.lit(1).cast("long")).alias("v")))
        spread = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.lpad(F.hex(F.coalesce(m[i], F.lit(0).cast("long"))), 4, "0")), "")
        # an array of one element binds the map to a name: it is made once, not once per slot
        return F.when(F.size(s) > 0, F.transform(F.array(F.map_from_entries(entries)), spread)[0]).otherwise(EMPTY)


class _Wide(_Packed):
    """Elements as pairs of the same hash and a whole place, for texts with more places than PLACE."""

    name = "w"

    def placed(self, h: Column, i: Column) -> Column:
        return F.struct(h.bitwiseAND(F.lit(HASH)).alias("h"), i.alias("i"))

    def hash_of(self, x: Column) -> Column:
        return x["h"]

    def place_of(self, x: Column) -> Column:
        return x["i"]

    def slot(self, x: Column) -> Column:
        return F.shiftrightunsigned(x["h"], SLOT_SHIFT)

    def in_text_order(self, mine: Column) -> Column:
        order = F.sort_array(F.transform(mine, lambda x: F.struct(x["i"].alias("i"), F.shiftrightunsigned(x["h"], PLACE_BITS).alias("h"))))
        return F.transform(order, lambda x: x["h"])


_PACKED, _WIDE = _Packed(), _Wide()


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots among those that either fingerprint fills; 1 where neither fills any."""
    at = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    part = lambda f, i: F.substring(F.hex(f), i * 4 + 1, F.lit(4))
    pairs = F.transform(at, lambda i: F.struct(part(a, i).alias("a"), part(b, i).alias("b")))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != "0000")))
    held = F.size(F.filter(pairs, lambda p: (p["a"] != "0000") | (p["b"] != "0000")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(equal, held), F.lit(0.0)))


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` (id unique and not null, and further columns) with prev_* and next_* of every column; the ends are tied to each other."""
    n = ids.count()
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK_ROWS))
    bounds = []
    if blocks > 1:
        cuts = [i / blocks for i in range(1, blocks)]
        bounds = sorted(set(ids.agg(F.percentile_approx("id", F.array(*map(F.lit, cuts)), F.lit(20 * blocks))).first()[0]))
    wide = 64
    if bounds:
        tops, every = F.array(*map(F.lit, bounds[::wide])), F.array(*map(F.lit, bounds))
        above = F.greatest(F.size(F.filter(tops, lambda b: b < F.col("id"))) - 1, F.lit(0)) * wide
        block = above + F.size(F.filter(F.slice(every, above + 1, wide), lambda b: b < F.col("id")))
    else:
        block = F.lit(0)
    dealt = ids.withColumn("block", block)
    row = F.struct(*ids.columns)
    inside = W.partitionBy("block").orderBy("id")
    tied = dealt.select("block", row.alias("own"), F.lag(row).over(inside).alias("prev"), F.lead(row).over(inside).alias("next"))
    ends = dealt.groupBy("block").agg(F.min_by(row, "id").alias("first"), F.max_by(row, "id").alias("last"))
    order, ring = W.orderBy("block"), W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "block", F.coalesce(F.lag("last").over(order), F.last("last").over(ring)).alias("before"), F.coalesce(F.lead("first").over(order), F.first("first").over(ring)).alias("after")
    )
    tied = tied.join(F.broadcast(ends), "block").select("own", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    return tied.select("own.*", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("prev", "next") for c in ids.columns])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited text: its last half replaced by as much of the beginning of the next document.

    Returns id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, one row per row of ``docs``. A null id has no
    next document: its half is replaced by nothing, and near_next compares with the empty text. Of rows that share an id, the one with the least text hash stands
    for the document where a neighbour looks at it. Texts move twice: a document to where its neighbours are known, and the beginning
    that the document before needs.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    printed = fingerprint(base, F.col("text"), "fp").select("id", "th", half.alias("half"), "fp")
    thin = spill(printed, "fingerprints")
    per_id = spill(
        thin.filter("id IS NOT NULL").groupBy("id").agg(F.collect_set(F.struct("th", "fp")).alias("prints"), F.max("half").alias("need")), "fingerprints-by-id"
    )
    beside = spill(neighbours(per_id.select("id", "need")).select(F.col("id").alias("b_id"), "prev_id", "prev_need"), "fingerprint-neighbours")
    met = base.select("id", "text").join(per_id.select(F.col("id").alias("p_id"), "prints"), F.col("id") == F.col("p_id"))
    stand = F.array_min("prints")
    heads = (
        # not an equality of two sides, which would become a key of the join and move the texts once more
        met.join(beside, F.col("id") == F.col("b_id")).filter(F.exists(F.array(stand), lambda p: p["th"] == F.xxhash64("text")))
        .select(F.col("prev_id").alias("h_id"), F.substring(F.col("text"), F.lit(1), F.col("prev_need")).alias("head"), stand["fp"].alias("next_fp"))
        .groupBy("h_id").agg(F.first("head").alias("head"), F.first("next_fp").alias("next_fp"))
    )
    none = F.unhex(F.lit(EMPTY))
    own = met.select("id", "text", F.filter("prints", lambda p: p["th"] == F.xxhash64("text"))[0]["fp"].alias("fp"))
    both = own.join(heads, F.col("id") == F.col("h_id"), "left").select("id", "text", "fp", "next_fp", "head")
    lone = fingerprint(base.filter("id IS NULL").select("id", "text"), F.col("text"), "fp").select("id", "text", "fp", none.alias("next_fp"), F.lit("").alias("head"))
    both = both.unionByName(lone)
    size = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    both = both.select("id", size.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited_text"))
    both = fingerprint(both, F.col("edited_text"), "efp")
    hexed = lambda c: F.lower(F.hex(c))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_text", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
