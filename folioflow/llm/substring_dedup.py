"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash of its ``MINI``-word runs, so equal
windows have equal minimisers. Consecutive windows that share a minimiser form a super-k-mer: it travels as one packed
string to the bucket of its minimiser, where windows are sorted by a 128-bit hash and the least document of each is found. A word
is removed where a window that covers it also starts in a document with a smaller id.

Most minimisers occur in one document only, and windows under them can't repeat. They are told apart beforehand by
a Bloom filter of bounded size (of minimisers that two documents hold): its false positives travel and change nothing.
A task sends a packed string once, however many of its documents hold it, so a passage that many documents share arrives once from each task;
what is found for a string goes back to its occurrences by a join whose hot keys adaptive execution splits.

Copies of a whole text repeat all its windows: those of the ``COPIES`` largest groups are marked at once and take no further part. Copies in
smaller groups go the way of all others, so the bound changes no result.

A minimiser under which more than ``HOT`` strings arrive isn't sorted in one bucket: its strings are cut into windows, the least document of each
window is aggregated before the shuffle, and the join that brings it back is one that adaptive execution can split.

The filter is bounded by ``max_bits``, about 16 million minimisers or 0.5 GB of text at the default; beyond it more minimisers that don't repeat pass and
their strings travel too, up to all of them: some three times the text, before compression. No result depends on it.

Windows are judged on the input, never on what is left. Null and empty texts have no words. A null id is neither smaller
nor larger than another: such a row is left whole. Rows that share an id don't repeat each other. Tables without rows, ties and extra
columns need no rule; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bitfilter, wordhash
from folioflow.llm.training import slices
from folioflow.plans.materialize import spill

WINDOW, MINI = 13, 4
U = np.uint64
LOW = (1 << 64) - 1
SENT = 100_000  # strings that a task remembers to have sent
WORDS = 150_000  # word hashes that a task keeps
BATCH = 128  # documents handled at once
COPIES = 50_000  # groups of equal texts, the largest, whose copies are told apart beforehand
CHUNK = 20_000  # packed strings sorted at once, at most HOT more
HOT = 5_000


def minimisers(h: np.ndarray, window: int, mini: int) -> np.ndarray:
    """The minimiser of each window of word hashes."""
    g = wordhash.rolled(h, mini)
    span = window - mini + 1
    have, out = 1, g
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(texts: list[list[bytes]], cache: wordhash.WordHashes, window: int, mini: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser) of the super-k-mers of many texts, given as words. All texts are handled as one array of words."""
    counts = np.array([len(w) for w in texts], np.int64)
    m = minimisers(cache.of(list(chain.from_iterable(texts))), window, mini)
    ends = np.cumsum(counts)
    text_of = np.repeat(np.arange(len(texts)), counts)[: len(m)]
    at = np.arange(len(m))
    inside = at + window <= ends[text_of] if len(m) else np.empty(0, bool)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (text_of[1:] != text_of[:-1])
    starts = at[new & inside]
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U)
    last = np.minimum(np.append(starts[1:], len(m) + window), (ends - window + 1)[text_of[starts]])
    owner = text_of[starts]
    return owner, starts - (ends - counts)[owner], last - starts, m[starts]


def _copies(frame: pd.DataFrame, first: dict[tuple[int, int], int]) -> np.ndarray:
    """Which rows repeat, as a whole, a text of a smaller id."""
    keys = zip(frame["th"].tolist(), frame["th2"].tolist(), frame["id"].tolist(), strict=True)
    return np.fromiter((i > first.get((a, b), i) for a, b, i in keys), bool, len(frame))


def _held(window: int, mini: int, first):
    """The distinct minimisers of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = wordhash.WordHashes(WORDS)
        for frame in slices(frames, BATCH):
            frame = frame[~_copies(frame, first.value)]
            owner, _, _, keys = super_kmers([wordhash.split(t) for t in frame["text"]], cache, window, mini)
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            yield pd.DataFrame({"mini": keys[once].view(np.int64)})

    return run


def _super_kmers(window: int, mini: int, bloom, first):
    """Super-k-mers whose minimiser the filter lets through. A string that a task has sent before isn't sent again.

    ``role`` is 2 where the packed string goes along to its bucket, 1 where only the id does (a smaller or a first larger one), 3 for
    a copy of a whole text, whose windows ``start`` counts, else 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = wordhash.WordHashes(WORDS)
        sent: dict[tuple[int, int], tuple[int, int]] = {}
        bits = bloom.value
        size = np.uint64(len(bits) * 64 - 1)
        for frame in slices(frames, BATCH):
            if len(sent) > SENT:
                sent.clear()
            again = _copies(frame, first.value)
            copies, frame = frame[again], frame[~again]
            if len(copies):
                windows = np.array([len(wordhash.split(t)) - window + 1 for t in copies["text"]])
                copies, windows = copies[windows > 0], windows[windows > 0]
                zeros = np.zeros(len(copies), np.int64)
                yield _rows(zeros, copies["id"].to_numpy(), copies["th"].to_numpy(), windows, zeros, zeros + 3, [None] * len(copies))
            words = [wordhash.split(t) for t in frame["text"]]
            owner, start, count, keys = super_kmers(words, cache, window, mini)
            at = keys & size
            go = ((bits[at >> U(6)] >> (at & U(63))) & U(1)).astype(bool)
            owner, start, count, keys = owner[go], start[go], count[go], keys[go]
            p0, roles, packed = [], [], []
            ids = frame["id"].to_numpy()[owner]
            for o, s, n, i, m in zip(owner.tolist(), start.tolist(), count.tolist(), ids.tolist(), keys.tolist(), strict=True):
                text = b" ".join(words[o][s : s + n + window - 1])
                digest = xxhash.xxh3_64_intdigest(text)
                key = (m, digest)
                p0.append(digest)
                known = sent.get(key)
                if known is None:
                    sent[key] = (i, i)
                    roles.append(2)
                    packed.append(text.decode("utf-8", "surrogatepass"))
                    continue
                lo, hi = known
                tell = i < lo or i > hi == lo
                if i < lo or i > hi:
                    sent[key] = (min(i, lo), max(i, hi))
                roles.append(int(tell))
                packed.append(None)
            yield _rows(keys.view(np.int64), ids, frame["th"].to_numpy()[owner], start, np.array(p0, U).view(np.int64), roles, packed)

    return run


def _rows(mini, ids, th, start, p0, role, packed) -> pd.DataFrame:
    return pd.DataFrame({
        "mini": np.asarray(mini, np.int64), "id": np.asarray(ids, np.int64), "th": np.asarray(th, np.int64), "start": np.asarray(start, np.int32), "p0": np.asarray(p0, np.int64),
        "role": np.asarray(role, np.int8), "packed": pd.Series(packed, dtype=object),
    })


def _count(window: int):
    """The least document of every window of the packed strings that arrive sorted by minimiser.

    Equal windows have equal minimisers, so any stretch that holds whole minimisers can be sorted by itself. Only strings
    with a window that starts in a smaller id than one of theirs are returned.
    """

    def sort(frame: pd.DataFrame, cache: wordhash.WordHashes) -> pd.DataFrame:
        mini, p0, ids = frame["mini"].to_numpy(), frame["p0"].to_numpy(), frame["id"].to_numpy()
        has = frame["packed"].notna().to_numpy()
        order = np.lexsort((~has, p0, mini))
        mini, p0, ids = mini[order], p0[order], ids[order]
        first = np.ones(len(p0), bool)
        first[1:] = (p0[1:] != p0[:-1]) | (mini[1:] != mini[:-1])
        heads = np.flatnonzero(first)
        lo, hi = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
        words = [s.encode("utf-8", "surrogatepass").split() for s in frame["packed"].to_numpy()[order[heads]]]
        sizes = np.array([len(w) for w in words])
        counts = sizes - window + 1
        h = cache.of(list(chain.from_iterable(words)))
        ends, tops = np.cumsum(sizes), np.cumsum(counts)
        at = np.arange(tops[-1]) + np.repeat(ends - sizes - (tops - counts), counts)
        a, b = (wordhash.rolled(h, window, seed)[at] for seed in (1, 2))
        doc = np.repeat(lo, counts)
        order = np.lexsort((doc, b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = np.empty(len(a), np.int64)
        least[order] = doc[order][new][np.cumsum(new) - 1]
        late = least < np.repeat(hi, counts)
        some = np.flatnonzero(np.add.reduceat(late, tops - counts) > 0)
        cut = [least[t - c : t] for t, c in zip(tops[some].tolist(), counts[some].tolist(), strict=True)]
        return pd.DataFrame({"mini": mini[heads][some], "p0": p0[heads][some], "least": pd.Series(cut, dtype=object)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, held, rows = wordhash.WordHashes(WORDS), [], 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows < CHUNK:
                continue
            whole, rows = pd.concat(held, ignore_index=True), 0
            keys = whole["mini"].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield sort(whole.iloc[:cut], cache)
            held = [whole.iloc[cut:]]
        whole = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(whole):
            yield sort(whole, cache)

    return run


def _windows(window: int):
    """The windows of packed strings: (mini, p0, k, a, b, lo, hi), a and b being the 128-bit hash of the k-th window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = wordhash.WordHashes(WORDS)
        for frame in slices(frames, CHUNK):
            words = [s.encode("utf-8", "surrogatepass").split() for s in frame["packed"]]
            sizes = np.array([len(w) for w in words], np.int64)
            counts = sizes - window + 1
            h, tops = cache.of(list(chain.from_iterable(words))), np.cumsum(counts)
            k = np.arange(counts.sum()) - np.repeat(tops - counts, counts)
            at = k + np.repeat(np.cumsum(sizes) - sizes, counts)
            a, b = (wordhash.rolled(h, window, seed)[at].view(np.int64) for seed in (1, 2))
            own = {c: np.repeat(frame[c].to_numpy(), counts) for c in ("mini", "p0", "lo", "hi")}
            yield pd.DataFrame(own | {"k": k.astype(np.int32), "a": a, "b": b})

    return run


def _hot(sent: DataFrame, window: int) -> DataFrame:
    """What ``_count`` gives, for strings of hot minimisers."""
    strings = sent.groupBy("mini", "p0").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("packed").alias("packed"))
    windows = spill(strings.mapInPandas(_windows(window), "mini long, p0 long, lo long, hi long, k int, a long, b long"), "hot-windows")
    least = spill(windows.groupBy("a", "b").agg(F.min("lo").alias("least")), "hot-least")
    met = windows.join(least, ["a", "b"]).groupBy("mini", "p0").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("each"), F.max(F.col("least") < F.col("hi")).alias("late"))
    return met.filter("late").select("mini", "p0", F.transform("each", lambda x: x["least"]).alias("least"))


def _collected(bloom: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array; ``bits`` bounds it."""
    out = np.zeros(bits // 64, np.int64)
    found = bloom.toPandas()
    for chunk, words in zip(found["chunk"], found["words"], strict=True):
        out[chunk * 64 : chunk * 64 + 64] = words
    return out.view(np.uint64)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mini: int = MINI, max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """(id, th, starts): for each document, the first words of windows that also start in a smaller id. th is xxhash64 of the text."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    texts = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2"), text.alias("text"))
    thin = spill(texts.select("id", "th", "th2", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars")), "text-hashes")
    words = (thin.agg(F.sum("chars")).first()[0] or 0) / 6
    same = thin.groupBy("th", "th2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    first = spark.sparkContext.broadcast({(r["th"], r["th2"]): r["lo"] for r in same.orderBy(F.desc("n"), "th", "th2").limit(COPIES).collect()})
    bits = bitfilter.bits_for(int(words / ((window - mini + 2) / 2)), max_bits)
    held = texts.mapInPandas(_held(window, mini, first), "mini long")
    twice = held.select(F.col("mini").bitwiseAND(bits - 1).alias("pos")).groupBy("pos").count().filter("count > 1").select("pos")
    bloom = spark.sparkContext.broadcast(_collected(bitfilter.build(twice), bits))
    cand = spill(texts.mapInPandas(_super_kmers(window, mini, bloom, first), "mini long, id long, th long, start int, p0 long, role byte, packed string"), "super-kmers")
    sent = cand.filter("role IN (1, 2)").select("mini", "p0", "id", "packed")
    places = bitfilter.bits_for(sent.count() // (HOT // 10), max_bits)
    place = bitfilter.positions(F.col("mini"), places, 1)[0]
    crowded = spill(sent.groupBy(place.alias("pos")).count().filter(F.col("count") > HOT).select("pos"), "hot-minimisers")
    hot = None
    if crowded.count():
        probed = bitfilter.probe(sent, bitfilter.build(crowded), F.col("mini"), places, "hot", 1)
        sent, hot = probed.filter("NOT hot").drop("hot"), probed.filter("hot").drop("hot")
    counted = sent.repartition("mini").sortWithinPartitions("mini").mapInPandas(_count(window), "mini long, p0 long, least array<long>")
    if hot is not None:
        counted = counted.unionByName(_hot(hot, window))
    late = F.filter(F.transform("least", lambda d, k: F.when(d < F.col("id"), F.col("start") + k)), lambda s: s.isNotNull())
    met = cand.filter("role < 3").select("mini", "p0", "id", "th", "start").join(counted, ["mini", "p0"]).select("id", "th", late.alias("starts")).filter(F.size("starts") > 0)
    copied = cand.filter("role = 3").select("id", "th", F.sequence(F.lit(0), F.col("start") - 1).alias("starts"))
    met = met.unionByName(copied)
    return met.groupBy("id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"))



def _kept(window: int):
    """The words that no repeated window covers, joined by one space."""

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def kept(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for text, starts in zip(texts, marks, strict=True):
            words = wordhash.split(text)
            n = len(words)
            if starts is not None and len(starts):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.asarray(starts) + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return kept


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mini: int = MINI, max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text. Documents without a repeated window don't shuffle."""
    marks = spill(repeated_windows(docs, id_col, text_col, window, mini, max_bits), "repeated-windows")
    bits = bitfilter.bits_for(marks.count())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    packed = packed.select("doc", F.col(f"doc.`{id_col}`").cast("long").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    probed = bitfilter.probe(packed, bitfilter.present(marks.select("id"), bits), F.col("id"), bits, "maybe")
    none = F.lit(None).cast("array<int>")
    passed = probed.filter("NOT maybe OR id IS NULL").select("doc", "text", none.alias("starts"))
    maybe = probed.filter("maybe AND id IS NOT NULL").withColumn("th", F.xxhash64("text")).join(marks, ["id", "th"], "left").select("doc", "text", "starts")
    out = passed.unionByName(maybe).withColumn("out", _kept(window)("text", "starts"))
    new = ["n_words", "n_removed", "kept_text"]
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in new], *[F.col(f"out.{c}") for c in new])
