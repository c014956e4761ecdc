"""The trie of the prefixes that conversations share.

A conversation is a path of turns (role, text); a node is a distinct sequence of the first d turns, the root the empty one, and its members are the
conversations that begin with it. How many tokens a cache of prefixes saves at a node follows from the members.

Conversations come in families: ``c`` belongs to the base ``c - c % 20``. Trees are merged family first. Rows lose their texts before they move (a digest
and a number of words remain), the rows of a family and of its base meet in a cogroup, which rebuilds the conversations and makes the family's small trie. Only its
nodes, one for each family, move on. Nodes that two families or more share are counted by key; all others are final in their family. With what is known of
the shared nodes, a family sums up the subtrees of its own nodes, taking a shared node into account only if the node's least member is its own;
these sums add up over the families. So a shared node counts once, no round per level is needed, and a node in very many families (the root, a
common first turn) is aggregated before it moves.

A family of more than ``LONG`` turns isn't held by a task. Its conversations are rebuilt as rows: places, keys and sums over what follows are prefix sums, taken over slices of
``SLICE`` turns first and inside them afterwards (``long_paths``), which sums of hashes allow. Its nodes join those of the other families.

A node is known by a sum modulo 2^128 of hashes of (place, turn): the key of a prefix grows by addition, and paths agree if their keys do.
Ends of a node, the conversations with just its turns, are written in order: in a family first, then by blocks of families, and where
a node has several blocks their digest is taken by streaming the sorted blocks through one hash, so that no list of all ends is ever held.

Nulls: rows without an id belong to no conversation and are left out; a null turn comes first; null roles and texts are empty. Rows of equal turn go by the
digest of role and text; repeated rows are turns of their own. Empty texts have no words and are turns like others. Other columns are ignored. An empty table gives no
node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.words import word_count
from folioflow.plans.materialize import spill

FAMILY = 20
#: Families whose ends are joined into one block.
BLOCK = 1000
#: Turns of a family that a task holds, and of a slice of a longer one.
LONG, SLICE = 200_000, 10_000
ROOT = bytes(16)
_MASK = (1 << 128) - 1

FAMILY_NODES = "base long, key binary, depth long, parent binary, words long, n long, least long, inner boolean, ends string"
_FAMILY = pa.schema([
    ("base", pa.int64()), ("key", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("words", pa.int64()), ("n", pa.int64()), ("least", pa.int64()),
    ("inner", pa.bool_()), ("ends", pa.string()),
])
SUMMED_NODES = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shared boolean"
_SUMMED = pa.schema([
    ("key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends", pa.string()), ("shared", pa.bool_()),
])

#: A turn of a family: conversation, turn, digest, words.
Turn = tuple[int, int | None, bytes, int]


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def taken_over(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % 4


def grown(key: bytes, depth: int, digest: bytes) -> bytes:
    """The key of the prefix that has ``digest`` at ``depth`` after the prefix of ``key``."""
    step = hashlib.md5(b"%d:" % depth + digest, usedforsecurity=False).digest()
    return (int.from_bytes(key, "big") + int.from_bytes(step, "big") & _MASK).to_bytes(16, "big")


def rebuilt(base: Iterable[Turn], own: Iterable[Turn]) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """Every conversation of a family in order of id: its id and turns (digest, words), the first ones taken from the base."""
    order = lambda t: (t[0], t[1] is not None, t[1] or 0, t[2])
    shared = [t[2:] for t in sorted(base, key=order)]
    for conv_id, turns in groupby(sorted(own, key=order), key=lambda t: t[0]):
        h = taken_over(conv_id)
        yield conv_id, shared[:h] + [t[2:] for t in turns][h:]


def family_trie(conversations: Iterable[tuple[int, list[tuple[bytes, int]]]]) -> list[dict]:
    """The nodes of some conversations given in order of id; a node's parent stands before it."""
    nodes: dict[bytes, dict] = {}
    for conv_id, turns in conversations:
        key, parent = ROOT, None
        for depth, (digest, words) in enumerate([(b"", 0), *turns]):
            if depth:
                key, parent = grown(key, depth, digest), key
                nodes[parent]["inner"] = True
            node = nodes.setdefault(key, {"key": key, "depth": depth, "parent": parent, "words": words, "n": 0, "least": conv_id, "inner": False, "ends": []})
            node["n"] += 1
        nodes[key]["ends"].append(str(conv_id))
    return [node | {"ends": ",".join(node["ends"])} for node in nodes.values()]


def _tuples(table: pa.Table, names: tuple[str, ...]) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in names), strict=True))


def _family(base: pa.Table, own: pa.Table) -> pa.Table:
    columns = ("conv_id", "turn", "digest", "words")
    nodes = family_trie(rebuilt(_tuples(base, tuple(f"of_{c}" for c in columns)), _tuples(own, columns)))
    family = own["base"][0].as_py() if own.num_rows else 0
    return pa.Table.from_pylist([{"base": family} | node for node in nodes], schema=_FAMILY)


def summed(nodes: list[dict]) -> list[dict]:
    """Nodes of a family, with what all families know of them, with sums over their subtrees: of those nodes alone that are this family's to count."""
    found = {}
    for node in sorted(nodes, key=lambda x: x["depth"]):
        counts = node["own"]
        found[node["key"]] = node | {
            "conv_id": node["least"], "n_convs": node["n"], "parent_conv_id": found[node["parent"]]["least"] if node["depth"] else None, "n_children": 0,
            "n_leaves": int(counts and not node["inner"]), "saved_tokens": (node["n"] - 1) * node["words"] if counts else 0,
        }
    for node in reversed(found.values()):
        if node["depth"]:
            above = found[node["parent"]]
            above["n_children"] += node["own"]
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    return list(found.values())


def _sum_family(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([{c: node[c] for c in _SUMMED.names} for node in summed(table.to_pylist())], schema=_SUMMED)


def thin_turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, words): turns without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), word_count(F.col("text")).alias("words"))
    return rows.select(base_of(F.col("conv_id")).alias("base"), "*")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    conv_id (least member), depth, parent_conv_id (least member of the parent, null for the root), n_convs, n_children, n_leaves and saved_tokens (over the
    subtree, the node included), ends_sha256 (of the ids that end here, in order, joined by commas).
    """
    turns = thin_turns(conversations)
    long = spill(turns.groupBy("base").agg(F.count("*").alias("n")).filter(F.col("n") > LONG).select("base"), "trie-long")
    paths = None
    if not long.isEmpty():
        paths = spill(long_paths(turns.join(long, "base", "left_semi")), "trie-paths")
        turns = turns.join(long, "base", "left_anti")
    bases = turns.filter("conv_id = base").select(*[F.col(c).alias(f"of_{c}") for c in turns.columns])  # the sides of a cogroup mustn't share columns
    families = bases.groupBy("of_base").cogroup(turns.groupBy("base")).applyInArrow(_family, FAMILY_NODES)
    families = spill(families if paths is None else families.unionByName(long_nodes(paths)), "trie-families")
    counted = families.groupBy("key").agg(
        F.sum("n").alias("all_n"), F.min("least").alias("all_least"), F.bool_or("inner").alias("all_inner"), F.count("*").alias("families")
    )
    shared = spill(counted.filter("families > 1").drop("families"), "trie-shared")
    known = families.join(shared, "key", "left")
    is_shared = F.col("all_n").isNotNull()
    of_all = known.select(
        "base", "key", "depth", "parent", "words", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_least", "least").alias("least"),
        F.coalesce("all_inner", "inner").alias("inner"), F.coalesce(base_of(F.col("all_least")) == F.col("base"), F.lit(True)).alias("own"),
        F.when(~is_shared, F.col("ends")).alias("ends"), is_shared.alias("shared"), F.col("least").alias("first"),
    )
    if paths is None:
        sums = of_all.drop("first").groupBy("base").applyInArrow(_sum_family, SUMMED_NODES)
    else:
        of_all = spill(of_all, "trie-known")
        small = of_all.join(long, "base", "left_anti").drop("first").groupBy("base").applyInArrow(_sum_family, SUMMED_NODES)
        sums = small.unionByName(long_sums(paths, of_all.join(long, "base", "left_semi")))
    sums = spill(sums, "trie-sums")
    alone = sums.filter(~F.col("shared"))
    met = sums.filter("shared").groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    met = met.join(shared_ends(families, shared), "key", "left")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return alone.select(*shown, _sha(F.col("ends")).alias("ends_sha256")).unionByName(
        met.select(*shown, F.coalesce("ends_sha256", _sha(F.lit(""))).alias("ends_sha256"))
    )


LIMBS = 4  # a key is four numbers of 32 bits, the highest first; their sums carry over


def _limbs(depth: Column, digest: Column) -> list[Column]:
    """What a turn adds to a key, as ``grown`` has it."""
    h = F.md5(F.concat(F.encode(F.concat(depth.cast("string"), F.lit(":")), "UTF-8"), digest))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LIMBS)]


def _key(sums: list[Column]) -> Column:
    carry, parts = F.lit(0), []
    for total in reversed(sums):
        total = total + carry
        parts.append(F.lpad(F.hex(total.bitwiseAND(0xFFFFFFFF)), 8, "0"))
        carry = F.shiftright(total, 32)
    return F.unhex(F.concat(*reversed(parts)))


def _running(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (conv_id, d, ...), written, with ``values`` summed up over d: slices first, then inside each slice."""
    sliced = rows.withColumn("slice", F.floor(F.col("d") / SLICE))
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sliced.groupBy("conv_id", "slice").agg(*[F.sum(v).alias(v) for v in values])
    starts = starts.select("conv_id", "slice", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inside = W.partitionBy("conv_id", "slice").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = sliced.select(*[c for c in sliced.columns if c not in values], *[F.sum(v).over(inside).alias(v) for v in values])
    return summed.join(starts, ["conv_id", "slice"]).select(*[c for c in rows.columns if c not in values], *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the place of each in its conversation: ranges of turns in order are counted first, then numbered inside each."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    salted = turns.withColumn("salt", F.monotonically_increasing_id())  # equal turns have no order; one range needn't hold them all
    ranged = spill(salted.repartitionByRange("conv_id", *order, "salt").withColumn("range", F.spark_partition_id()).drop("salt"), "trie-ranges")
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").count().select("conv_id", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = ranged.withColumn("at", F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order)))
    return inside.join(counts, ["conv_id", "range"]).withColumn("pos", F.col("start") + F.col("at")).drop("range", "start", "at", "turn")


def long_paths(turns: DataFrame) -> DataFrame:
    """(base, conv_id, d, key, parent, words, inner) of the rebuilt conversations of long families, a row for each prefix."""
    placed = spill(_placed(spill(turns, "trie-turns")), "trie-placed")
    own = placed.groupBy("base", "conv_id").agg(F.count("*").alias("n_own"))
    heads = placed.filter("conv_id = base AND pos <= 3").select("base", "pos", "digest", "words")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4
    convs = own.withColumn("h", h).join(heads.groupBy("base").agg(F.count("*").alias("n_heads")), "base", "left")
    taken = F.least("h", F.coalesce("n_heads", F.lit(0)))
    convs = spill(convs.select("base", "conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    first = convs.join(heads, "base").filter("pos <= taken").select("base", "conv_id", "length", F.col("pos").alias("d"), "digest", "words")
    rest = placed.drop("base").join(convs, "conv_id").filter("pos > h").select("base", "conv_id", "length", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "digest", "words")
    zero = [F.lit(0).cast("long").alias(f"x{i}") for i in range(LIMBS)]
    steps = first.unionByName(rest)
    steps = steps.select("base", "conv_id", "length", "d", "words", *[x.alias(f"x{i}") for i, x in enumerate(_limbs(F.col("d"), F.col("digest")))])
    roots = convs.select("base", "conv_id", "length", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"), *zero)
    names = [f"x{i}" for i in range(LIMBS)]
    steps = spill(steps.unionByName(roots).withColumns({f"own{i}": F.col(f"x{i}") for i in range(LIMBS)}), "trie-steps")
    keyed = _running(steps, names)
    less = _key([F.col(f"x{i}") - F.col(f"own{i}") for i in range(LIMBS)])
    return keyed.select("base", "conv_id", "d", _key([F.col(n) for n in names]).alias("key"), F.when(F.col("d") > 0, less).alias("parent"), "words", (F.col("d") < F.col("length")).alias("inner"))


def long_nodes(paths: DataFrame) -> DataFrame:
    """The nodes of long families, as ``family_trie`` has them: a family has no more than 39 conversations, whatever their length."""
    ends = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("inner"), F.col("conv_id")))), lambda c: c.cast("string")), ",")
    return paths.groupBy("base", "key").agg(
        F.min("d").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.bool_or("inner").alias("inner"), ends.alias("ends"),
    ).select(*[f.name for f in _FAMILY])


def long_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``summed``, for long families: each counted node is counted on the path of its family's least member, and sums over what follows on a path add up to those of subtrees."""
    met = paths.select("base", "conv_id", "d", "key", "parent").join(nodes.drop("parent"), ["base", "key"])
    counts = (F.col("own") & (F.col("conv_id") == F.col("first"))).alias("counts")
    rows = spill(met.select("*", counts).select(
        "base", "conv_id", "d", "key", "parent", F.col("counts").cast("long").alias("mine"), (F.col("counts") & ~F.col("inner")).cast("long").alias("leaf"),
        F.when(F.col("counts"), (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved"),
    ), "trie-values")
    upto = _running(rows.select("base", "conv_id", "d", "key", "leaf", "saved", F.col("leaf").alias("leaf0"), F.col("saved").alias("saved0")), ["leaf", "saved"])
    whole = rows.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("total"))
    after = upto.join(whole, "conv_id").groupBy("base", "key").agg(
        F.sum(F.col("leaves") - F.col("leaf") + F.col("leaf0")).alias("n_leaves"), F.sum(F.col("total") - F.col("saved") + F.col("saved0")).alias("saved_tokens")
    )
    children = rows.filter("d > 0 AND mine > 0").groupBy("base", F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select("base", F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    found = nodes.join(above, ["base", "parent"], "left").join(after, ["base", "key"]).join(children, ["base", "key"], "left")
    return found.select(
        "key", F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", "ends", "shared"
    )


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def shared_ends(families: DataFrame, shared: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, ends_sha256) of shared nodes where conversations end.

    Families are ranges of ids, so lists of families joined in order of base are in order of id, and so are those of blocks of ``block`` families.
    """
    ends = families.filter("ends <> ''").join(shared.select("key"), "key", "left_semi")
    blocks = ends.groupBy("key", F.floor(F.col("base") / (FAMILY * block)).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",").alias("ends")
    )
    blocks = spill(blocks, "trie-ends")
    several = blocks.groupBy("key").count().filter("count > 1").select("key")
    one = blocks.join(several, "key", "left_anti").select("key", _sha(F.col("ends")).alias("ends_sha256"))
    rest = blocks.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "block")
    return one.unionByName(rest.select("key", "ends").mapInArrow(_stream_sha, "key binary, ends_sha256 string"))


def _stream_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of equal keys, fed block after block."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for key, run in groupby(rows, key=lambda r: r[0]):
        digest, joint = hashlib.sha256(), b""
        for _, ends in run:
            digest.update(joint)
            digest.update(ends.as_py().encode())
            joint = b","
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]}, schema=pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))
