"""Near-duplicates by b-bit MinHash.

Each document's distinct word shingles give ``BANDS * ROWS`` minima. Bands of minima are hashed for candidates; of every
minimum only the low ``BITS`` bits are kept, packed into longs. The similarity of a candidate pair is estimated by
counting equal lanes of the packed signatures, corrected for lanes that agree by chance; pairs whose estimate lies
further below the threshold than ``MARGIN`` are dropped, the rest are confirmed on full shingle sets. At a similarity of
0.8, 24 bands of 4 miss a pair with probability (1 - 0.8 ** 4) ** 24 = 3e-6, and the margin is more than six
standard deviations of the estimate.

Exact copies are one class from the start. Pairs are never listed. Members of a bucket are compared in blocks, and what a block
gives is a forest: no more links than members, which connect all that its pairs connect. The forests of estimates
make families; a family holds every true link of its members. Its full shingle sets are then compared in blocks of the
same kind, where two members already connected needn't be compared. Blocks are bounded, a large bucket or family is dealt
over many of them, every pair of members meets in one, and no member, bucket or partner is capped. Of buckets with the same
members one is kept.

Before that the links that the families are made of are confirmed, each by sending one text to the other's: what they connect is one, and
only families that then still fall apart are compared in blocks. Texts are sent, not shingle sets: they are smaller.

Lower-casing is of A-Z. A document with fewer words than a shingle is one shingle; without words (null text too) its set
is empty and it is linked with nothing. A null id is linked with nothing and has no component. Rows that share an id are
one document, which has the links of all its texts: their components are one. Ties need no rule: a component is named by its least id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bitfilter, wordhash
from folioflow.llm.components import components
from folioflow.llm.training import slices
from folioflow.plans.materialize import spill

BANDS, ROWS, BITS = 24, 4, 4
MARGIN = 0.25
BLOCK = 2048  # members of a bucket or family in half a block
BLOCK_SHINGLES = 1_000_000  # and their shingles
LANES = 64 // BITS
LOW_BITS = 0x1111111111111111
FEATURES = "id long, n_shingles long, k0 long, k1 long, sig array<long>, bands array<long>"


def signature(sets: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of a set of shingle hashes."""
    a, b = seeds
    least = np.full(len(a), ~np.uint64(0), np.uint64)
    for at in range(0, len(sets), 2048):
        np.minimum(least, (sets[None, at : at + 2048] * a[:, None] + b[:, None]).min(axis=1), out=least)
    minima = wordhash.mix(least)
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(-1, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    by_band = minima.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = wordhash.mix(keys ^ by_band[:, r]) + np.uint64(r)
    return np.bitwise_or.reduce(low, axis=1), keys


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    n = BANDS * ROWS
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def _features(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seeds = wordhash.WordHashes(), _seeds()
        for frame in slices(frames, 512):
            rows = []
            for i, text in zip(frame["id"], frame["text"], strict=True):
                found = wordhash.shingles(wordhash.split(text, lower=True), k, cache)
                if not len(found):
                    rows.append((i, 0, None, None, None, None))
                    continue
                sig, keys = signature(found, seeds)
                whole = [int(np.bitwise_xor.reduce(wordhash.mix(found + np.uint64(s))).view(np.int64)) for s in (1, 2)]
                rows.append((i, len(found), *whole, sig.view(np.int64), keys.view(np.int64)))
            out = pd.DataFrame(rows, columns=["id", "n_shingles", "k0", "k1", "sig", "bands"])
            yield out.astype({"id": "Int64", "k0": "Int64", "k1": "Int64"})

    return run


def least_agreeing(threshold: float) -> int:
    """Lanes that must agree for an estimate within the margin; agreement by chance is corrected for."""
    chance = 2.0**-BITS
    return int(np.floor(BANDS * ROWS * (chance + (1 - chance) * max(0.0, threshold - MARGIN))))


class Forest:
    """Who is connected within a block. Members of half i meet those of half j; within one half each pair meets once. ``label`` tells who is connected from the start."""

    def __init__(self, chunk: np.ndarray, i: int, j: int, sizes: np.ndarray, percent: int, label: np.ndarray | None = None):
        self.label = np.arange(len(chunk)) if label is None else np.unique(label, return_inverse=True)[1]
        self.rows = np.flatnonzero(chunk == i)
        self.cols = np.flatnonzero(chunk == j)
        self.one, self.sizes, self.percent = i == j, sizes, percent

    def grow(self, similar) -> list[tuple[int, int]]:
        """``similar(r, c)``: which of the members c are similar to r. Returns the links (r, c) that connect something new."""
        links = []
        for r in self.rows.tolist():
            c = self.cols[self.label[self.cols] != self.label[r]]
            c = c[c > r] if self.one else c
            c = c[100 * np.minimum(self.sizes[c], self.sizes[r]) >= self.percent * np.maximum(self.sizes[c], self.sizes[r])]
            if len(c):
                c = c[similar(r, c)]
                new, first = np.unique(self.label[c], return_index=True)
                if len(new):
                    links += [(r, x) for x in c[first].tolist()]
                    self.label[np.isin(self.label, new)] = self.label[r]
        return links


def _estimated(least: int, percent: int):
    """The forest of each block of bucket members, by packed signatures: (u, v)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in wordhash.groups(frames, ["key", "i", "j"]):
            ids, sizes = g["cid"].to_numpy(), g["n_shingles"].to_numpy()
            sig = np.stack(g["sig"].to_numpy()).astype(np.int64).view(np.uint64)

            def similar(r: int, c: np.ndarray) -> np.ndarray:
                x = sig[c] ^ sig[r]
                for s in (BITS // 2, BITS // 4):
                    x |= x >> np.uint64(s)
                return BANDS * ROWS - np.bitwise_count(x & np.uint64(LOW_BITS)).sum(axis=1, dtype=np.int64) >= least

            links = Forest(g["chunk"].to_numpy(), g["i"].iat[0], g["j"].iat[0], sizes, percent).grow(similar)
            if links:
                yield _links(links, ids)

    return run


class _Sets:
    """The shingle sets of a group of members as one array of kinds; which members are similar to one of them."""

    def __init__(self, held: list[np.ndarray], percent: int):
        self.sizes = np.array([len(h) for h in held])
        self.percent = percent
        kinds, self.flat = np.unique(np.concatenate(held), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.zeros(len(kinds), np.int32)

    def similar(self, r: int, c: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[r] : self.starts[r] + self.sizes[r]]
        self.marked[own] = 1
        if 4 * len(c) > len(self.sizes):
            both = np.add.reduceat(self.marked[self.flat], self.starts)[c]
        else:
            both = np.array([self.marked[self.flat[self.starts[x] : self.starts[x] + self.sizes[x]]].sum() for x in c.tolist()])
        self.marked[own] = 0
        return 100 * both >= self.percent * (self.sizes[c] + self.sizes[r] - both)


def _held(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Shingle sets in place of texts; members without one are left out."""
    cache = wordhash.WordHashes()
    for frame in slices(frames, 512):
        held = [wordhash.shingles(wordhash.split(t, lower=True), k, cache) for t in frame["text"]]
        yield frame.drop(columns="text").assign(held=held)[np.array([len(h) > 0 for h in held], bool)]


def _links(links: list[tuple[int, int]], ids: np.ndarray) -> pd.DataFrame:
    at = np.array(links)
    return pd.DataFrame({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})


def _confirmed(k: int, percent: int):
    """The links (u, v) between the hub of each group and its members that hold on full shingle sets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in wordhash.groups(_held(frames, k), ["hub", "chunk"]):
            ids = g["cid"].to_numpy()
            hub = np.flatnonzero(ids == g["hub"].iat[0])
            if len(hub) and len(ids) > 1:
                own, sets = int(hub[0]), _Sets(list(g["held"]), percent)
                others = np.flatnonzero(ids != ids[own])
                good = others[sets.similar(own, others)] if len(others) else others
                if len(good):
                    yield _links([(own, x) for x in good.tolist()], ids)

    return run


def _exact(k: int, percent: int):
    """The forest of each block of family members, by full shingle sets: (u, v)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in wordhash.groups(_held(frames, k), ["root", "i", "j"]):
            sets = _Sets(list(g["held"]), percent)
            links = Forest(g["chunk"].to_numpy(), g["i"].iat[0], g["j"].iat[0], sets.sizes, percent, g["label"].to_numpy()).grow(sets.similar)
            if links:
                yield _links(links, g["cid"].to_numpy())

    return run


def _dealt(members: DataFrame, group: str, parts: DataFrame) -> DataFrame:
    """Rows (group, chunk, i, j, cid): each member once for every pair of chunks that its own belongs to. ``parts`` has (group, parts)."""
    placed = members.join(parts, group).withColumn("chunk", F.pmod(F.xxhash64("cid"), "parts"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        *members.columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )


def _spokes(links: DataFrame) -> DataFrame:
    """Rows (hub, chunk, cid): the members linked to each hub in chunks of about BLOCK, and the hub itself in every chunk."""
    parts = links.groupBy(F.col("u").alias("hub")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    leaves = links.select(F.col("u").alias("hub"), F.col("v").alias("cid")).join(parts, "hub").select("hub", F.pmod(F.xxhash64("cid"), "parts").alias("chunk"), "cid")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"), F.col("hub").alias("cid"))
    return leaves.unionByName(hubs)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (id = component_id; true for a null id)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    features = spill(texts.mapInPandas(_features(shingle), FEATURES), "minhash")
    usable = features.filter("id IS NOT NULL AND n_shingles > 0")
    classes = spill(
        usable.groupBy("k0", "k1").agg(F.min("id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "minhash-classes",
    )
    n_docs = features.count()
    least = least_agreeing(percent / 100)
    banded = classes.select("cid", F.explode("bands").alias("key"))
    held = banded.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cid")).alias("all")).filter("lo < hi")
    buckets = held.groupBy("lo", "hi", "size", "all").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).alias("parts"))
    blocks = _dealt(banded, "key", buckets).join(classes.select("cid", "n_shingles", "sig"), "cid")
    near = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_estimated(least, percent), "u long, v long")
    near = spill(near.distinct(), "minhash-near")
    families = components(near)
    member = spill(families.select(F.col("node").alias("cid"), "root").unionByName(families.select(F.col("root").alias("cid"), "root").distinct()), "minhash-families")
    bits = bitfilter.bits_for(n_docs)
    probed = bitfilter.probe(texts, bitfilter.present(member.select("cid"), bits), F.col("id"), bits, "named").filter("named")
    texts_of = spill(probed.select(F.col("id").alias("cid"), "text"), "minhash-texts")

    spokes = _spokes(near).join(texts_of, "cid")
    sure = spill(spokes.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk").mapInPandas(_confirmed(shingle, percent), "u long, v long"), "minhash-sure")
    joined = components(sure)
    labelled = member.join(joined.select(F.col("node").alias("cid"), F.col("root").alias("label")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = spill(labelled, "minhash-labels")
    sized = labelled.join(classes.groupBy("cid").agg(F.max("n_shingles").alias("n_shingles")), "cid")
    apart = sized.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    blocks = _dealt(labelled, "root", apart.filter("lo < hi").select("root", "parts")).join(texts_of, "cid")
    more = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(_exact(shingle, percent), "u long, v long")
    # what is connected already is one node
    label = labelled.select("cid", "label")
    more = more.join(label.toDF("u", "lu"), "u").join(label.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    further = components(more).select(F.col("node").alias("label"), F.col("root").alias("top"))
    roots = label.join(further, "label", "left").select(F.col("cid").alias("node"), F.coalesce("top", "label").alias("root"))
    named = classes.select("k0", "k1", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("k0", "k1", F.coalesce("root", "cid").alias("root"))
    rows = features.select("id", "n_shingles", "k0", "k1").join(named, ["k0", "k1"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("root"))
    return _one_document_an_id(spill(rows, "minhash-rows")).select(
        F.col("id").alias(id_col), "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept")
    )


def _one_document_an_id(rows: DataFrame) -> DataFrame:
    """``rows`` (id, n_shingles, root) in which all components that rows of one id lie in are one."""
    torn = spill(rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high"), "minhash-torn")
    if torn.isEmpty():
        return rows
    tied = components(rows.join(torn, "id").select(F.col("root").alias("u"), F.col("low").alias("v")))
    whole = rows.join(tied.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return whole.select("id", "n_shingles", F.coalesce("top", "root").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with its columns. Rows outside any group don't shuffle."""
    decided = spill(near_duplicates(docs, id_col, text_col, shingle, percent).select(F.col(f"`{id_col}`").alias("id"), "kept"), "minhash-kept")
    doubtful = decided.groupBy("id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).filter("id IS NOT NULL AND (rows > 1 OR NOT kept)")
    doubtful = spill(doubtful.select("id", "kept"), "minhash-doubtful")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("id", F.col(f"doc.`{id_col}`").cast("long"))
    bits = bitfilter.bits_for(doubtful.count())
    probed = bitfilter.probe(packed, bitfilter.present(doubtful.select("id"), bits), F.col("id"), bits, "maybe")
    maybe = probed.filter("maybe AND id IS NOT NULL").join(doubtful.withColumnRenamed("id", "d_id"), F.col("id") == F.col("d_id"), "left")
    one = maybe.filter("kept").groupBy("id").agg(F.first("doc").alias("doc")).select("doc")
    return probed.filter("NOT maybe OR id IS NULL").select("doc").unionByName(maybe.filter("d_id IS NULL").select("doc")).unionByName(one).select("doc.*")
