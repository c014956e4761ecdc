"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

The vocabulary at hand is of the BPE kind, where pieces are merged by rank. A path of highest total score is not what such a
model means: it would cut many words differently. The search keeps its form and changes its score: a step from a piece to
the next scores 0 or minus infinity, and it scores 0 if merging by rank leaves just these two pieces of their joined text. A sequence
whose steps all score 0 is the result of merging, and there is only one. Models that aren't BPE, or that change texts before they cut them, are refused.

A batch of texts is one array of characters, cut into words where no piece spans the two characters; distinct words are encoded
once. Hashes of all substrings probe the sorted hashes of pieces. Words of equal length advance together, one character a step: the
scores of all pieces that end there lie in one array, words by piece lengths, and the place of the maximum of a row is the word's backpointer. Characters
without a piece become UTF-8 byte pieces.

Null and empty texts have no ids, and decode to the empty text. U+2581 stands for a space inside the vocabulary, so a text that contains it decodes with
a space in its place; every other text survives the round trip. The path of the model is a parameter; its tables, of fixed size, are
broadcast. Memory is bounded by ``BLOCK`` bytes of text, the longest text, ``CELLS`` scores and Spark's own bound of a batch. Rows are independent of each other: repeated rows, ties and null ids
need no rule, and other columns, whatever their names, pass through, but for those that the result replaces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces
BPE = 2  # the type of a model that merges by rank
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
NEVER = np.iinfo(np.int64).max
PAIRS = 1 << 20  # places for neighbours that a worker remembers
BLOCK = 1 << 20  # bytes handled as one array, more where one text has more
CELLS = 1 << 20  # scores held at once


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of ids. A model that isn't BPE, or that changes texts before cutting them, is refused."""
    out, trainer, normaliser = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            out.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if trainer.get(3, 1) != BPE:
        raise ValueError("not a BPE model: pieces can't be merged by rank")
    # the rules by which characters are replaced, the space put before a text, and spaces that are merged or written as they are
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("the normaliser of the model isn't the identity with a space put before the text")
    return out


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _merged(text: str, rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges that encoding ``text`` makes, in order; used once per piece to find its halves."""
    parts, made = list(text), []
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return made + [(p, "") for p in parts]
        i = best[1]
        made.append((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _spread(h: np.ndarray) -> np.ndarray:
    """A bijection that moves what tells hashes of short strings apart into the leading bits."""
    return (h ^ (h >> U(32))) * BASE


@dataclass
class Keys:
    """Sorted hashes, spread over 64 bits, each with a value; a directory over their leading bits tells where to look."""

    hashes: np.ndarray
    values: np.ndarray
    shift: np.uint64
    begins: np.ndarray
    most: int

    @staticmethod
    def of(found: dict[int, int]) -> Keys:
        hashes = _spread(np.array(list(found), U))
        order = np.argsort(hashes)
        hashes, values = hashes[order], np.array(list(found.values()), np.int32)[order]
        bits = max(8, int(len(hashes)).bit_length() + 1)
        shift = U(64 - bits)
        begins = np.searchsorted(hashes >> shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)
        return Keys(np.append(hashes, U(0)), np.append(values, np.int32(-1)), shift, begins, int(np.diff(begins).max(initial=0)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't listed."""
        h = _spread(h)
        lead = h >> self.shift
        at, end = self.begins[lead], self.begins[lead + U(1)]
        out = np.where((at < end) & (self.hashes[at] == h), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        for step in range(1, self.most):
            if not len(left):
                break
            hit = self.hashes[at[left] + step] == h[left]
            out[left[hit]] = at[left[hit]] + step
            left = left[~hit & (at[left] + step + 1 < end[left])]
        return out


@dataclass
class Tables:
    """A vocabulary as arrays: keys of pieces and of their beginnings, for each id its rank, length, hash and halves, and the pairs of characters inside pieces."""

    keys: Keys
    heads: Keys
    rank: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    letters: np.ndarray
    joined: np.ndarray
    bytes_at: int
    raw: list[bytes]
    longest: int
    cache: dict = field(default_factory=dict)

    @staticmethod
    def of(model: bytes) -> Tables:
        pieces = read_pieces(model)
        n = len(pieces)
        text = {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in (UNKNOWN, CONTROL, BYTE)}
        rank_of = {p: round(-pieces[i][1]) for p, i in text.items() if len(p) > 1}
        rank, length, hashes = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, U)
        left, right = np.arange(n), np.arange(n)
        usable = []
        for p, i in text.items():
            length[i], hashes[i] = len(p), _hash(p)
            if len(p) > 1:
                rank[i] = rank_of[p]
                made = _merged(p, rank_of)
                if made[-1] != (p, ""):
                    continue  # merging never arrives at this piece
                a, b = made[-2]
                left[i], right[i] = text.get(a, -1), text.get(b, -1)
            usable.append(i)
        letters = np.array(sorted({ord(c) for p in text if len(p) > 1 for c in p} | {0}), np.uint32)
        if any(chr(c) not in text for c in letters[1:].tolist()):
            raise ValueError("a letter of a piece has no piece of its own")
        joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        place = {chr(c): i for i, c in enumerate(letters.tolist())}
        for p in text:
            for a, b in zip(p, p[1:], strict=False):
                joined[place[a], place[b]] = True
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        bytes_at = next((i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE), 0)
        whole = {int(hashes[i]): i for i in usable}
        begun = {_hash(p[:k]): -1 for p in (pieces[i][0] for i in usable) for k in range(1, len(p) + 1)} | whole
        return Tables(Keys.of(whole), Keys.of(begun), rank, length, hashes, left, right, letters, joined, bytes_at, raw, int(length.max()))

    @property
    def power(self) -> np.ndarray:
        if "power" not in self.cache:
            self.cache["power"] = np.cumprod(np.concatenate([[U(1)], np.full(self.longest, BASE)]))
        return self.cache["power"]

    @property
    def pieces(self) -> np.ndarray:
        """The bytes that each id decodes to."""
        if "pieces" not in self.cache:
            self.cache["pieces"] = np.array(self.raw, object)
        return self.cache["pieces"]

    @property
    def of_letter(self) -> np.ndarray:
        """For each code point its place among the letters of pieces, past the last one if it is none."""
        if "of_letter" not in self.cache:
            table = np.full(0x110000, len(self.letters), np.int16)
            table[self.letters] = np.arange(len(self.letters))
            self.cache["of_letter"] = table
        return self.cache["of_letter"]

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves piece a beside piece b.

        The merges that made a and b are undone, the latest first. Any two pieces that so come to touch must not have merged
        with each other before one of them was merged away; of equal merges the left one is made first.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        while len(live):
            joined = self.keys.values[self.keys.find(self.hashes[a] * self.power[self.length[b]] + self.hashes[b])]
            clash = (joined >= 0) & (self.rank[joined] < limit)
            ok[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def permitted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``allowed``, remembered pair by pair."""
        if "pairs" not in self.cache:
            self.cache["pairs"] = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        keys, known = self.cache["pairs"]
        wanted = a.astype(np.int64) * len(self.rank) + b
        at = ((wanted.astype(U) * BASE) >> U(40)).astype(np.int64) & (PAIRS - 1)
        out = known[at]
        miss = np.flatnonzero(keys[at] != wanted)
        if len(miss):
            new, back = np.unique(wanted[miss], return_inverse=True)
            ok = self.allowed(new // len(self.rank), new % len(self.rank))
            out[miss] = ok[back]
            keys[at[miss]], known[at[miss]] = wanted[miss], out[miss]
        return out

    def ending(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each character, and each size, the piece of that size that ends there inside its word, or -1. ``ends`` tells where a character's word ends."""
        found = np.full((len(codes), self.longest), -1, np.int32)
        at = np.arange(len(codes))
        plus = codes.astype(U) + U(1)
        h = np.zeros(len(codes), U)
        for size in range(1, self.longest + 1):  # substrings that no piece begins with are followed no further
            h = h * BASE + plus[at + size - 1]
            place = self.heads.find(h)
            go = np.flatnonzero(place >= 0)
            at, h = at[go], h[go]
            found[at + size - 1, size - 1] = self.heads.values[place[go]]
            room = at + size < ends[at]
            at, h = at[room], h[room]
            if not len(at):
                break
        return found

    def advance(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each word has) of words of equal length, given as rows of characters."""
        count, n = words.shape
        longest = min(n, self.longest)
        last = np.full((count, n + 1), -1, np.int32)  # the backpointer: the last piece of the best path to a place
        every = np.arange(count)
        first = stop = 0  # the pieces at hand end from first to stop
        for end in range(1, n + 1):
            if end > stop:
                first, stop = stop, min(n, stop + max(1, CELLS // (count * self.longest)))
                left = max(0, first + 1 - longest)
                some = words[:, left:stop]
                pieces = self.ending(some.ravel(), np.repeat((every + 1) * some.shape[1], some.shape[1])).reshape(count, -1, self.longest)[:, first - left :]
            sizes = min(end, longest)
            piece = pieces[:, end - 1 - first, :sizes]
            before = last[:, end - sizes : end][:, ::-1]
            best = (piece >= 0) & (before >= 0)  # the scores: true for 0, false for minus infinity
            if end <= longest:  # a piece from the start has no step before it, and no other path then
                whole = piece[:, end - 1] >= 0
                best[whole] = False
            r, k = np.nonzero(best)
            best[r, k] = self.permitted(before[r, k], piece[r, k])
            if end <= longest:
                best[whole, end - 1] = True
            top = best.argmax(axis=1)
            last[:, end] = np.where(best[every, top], piece[every, top], -1)
        ids, at = np.full((count, n), -1, np.int32), np.full(count, n)
        rows = every
        for k in range(n - 1, -1, -1):  # from the end, all words at once
            ids[rows, k] = last[rows, at[rows]]
            at[rows] -= self.length[ids[rows, k]]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        used = ids >= 0
        return ids[used], used.sum(axis=1)

    def distinct(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each kind, kind of each word). Words of equal hash and length are compared; one that differs is a kind of its own."""
        ends = np.append(starts[1:], len(codes))
        if "powers" not in self.cache or len(self.cache["powers"]) <= len(codes):
            self.cache["powers"] = np.cumprod(np.concatenate([[U(1)], np.full(max(BLOCK, len(codes)) + 1, BASE)]))
        powers = self.cache["powers"]
        sums = np.concatenate([[U(0)], np.cumsum((codes.astype(U) + U(1)) * powers[: len(codes)])])
        h = (sums[ends] - sums[starts]) * powers[len(codes) - starts] + (ends - starts).astype(U)
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        model = first[kind]
        sizes = ends - starts
        same = sizes == sizes[model]
        shift = np.repeat(np.where(same, starts[model] - starts, 0), sizes)
        differs = codes[np.arange(len(codes)) + shift] != codes
        if differs.any() or not same.all():
            own = np.flatnonzero(~same | (np.add.reduceat(differs, starts) > 0))
            kind[own] = len(first) + np.arange(len(own))
            first = np.append(first, own)
        return first, kind

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each text has)."""
        held = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        letter = self.of_letter[codes]
        new = np.ones(len(codes), bool)
        new[1:] = ~self.joined[letter[:-1], letter[1:]]
        tops = np.cumsum(sizes)
        new[(tops - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(new)
        first, kind = self.distinct(codes, starts)
        lengths = np.append(starts[1:], len(codes)) - starts
        order = np.argsort(lengths[first], kind="stable")  # kinds by length
        pool, counts = self.kinds(codes, starts[first[order]], lengths[first[order]])
        begins = np.cumsum(counts) - counts
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine = place[kind]
        used = counts[mine]
        stops = np.cumsum(used)
        ids = pool[np.arange(stops[-1]) + np.repeat(begins[mine] - (stops - used), used)]
        upto = np.concatenate([[0], stops])[np.searchsorted(starts, tops)]
        return ids, np.diff(upto, prepend=0)

    def kinds(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each has) of words in order of length."""
        pool, counts = [], []
        single = int(np.searchsorted(lengths, 2))
        letters, which = np.unique(codes[starts[:single]], return_inverse=True)
        own = []
        for c in letters.tolist():
            found = int(self.keys.values[self.keys.find(np.array([c + 1], U))][0])
            own.append([found] if found >= 0 else [self.bytes_at + b for b in chr(c).encode("utf-8", "surrogatepass")])
        for w in which.tolist():
            pool.append(own[w])
        counts.append(np.array([len(p) for p in pool], np.int64))
        pool = [np.array([i for p in pool for i in p], np.int32)]
        at = single
        while at < len(starts):
            n = int(lengths[at])
            stop = min(int(np.searchsorted(lengths, n, "right")), at + max(1, CELLS // (n * self.longest)))
            ids, used = self.advance(codes[starts[at:stop, None] + np.arange(n)])
            pool.append(ids)
            counts.append(used)
            at = stop
        return np.concatenate(pool), np.concatenate(counts)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined, and the space put before the text is taken off."""
        if ids is None or not len(ids):
            return ""
        text = b"".join(self.pieces[np.asarray(ids)].tolist()).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_SHARED: dict[tuple[str, str], object] = {}


def shared(spark: SparkSession, model: str = MODEL):
    """The tables of the model at a path, broadcast once per application. A path with a scheme is read through Spark."""
    key = (spark.sparkContext.applicationId, model)
    if key not in _SHARED:
        if "://" in model:
            data = bytes(spark.read.format("binaryFile").load(model).first()["content"])
        else:
            with open(model, "rb") as f:
                data = f.read()
        _SHARED[key] = spark.sparkContext.broadcast(Tables.of(data))
    return _SHARED[key]


def blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in stretches of about ``BLOCK`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a).to_pylist()


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def _replaced(docs: DataFrame, source: str, made, names: dict[str, str]) -> DataFrame:
    """``docs`` with the fields of a column made of ``source`` under new names, in place of columns of those names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    packed = packed.select("doc", made(F.col(f"doc.`{source}`")).alias("made"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in names.values()]
    return packed.select(*kept, *[F.col(f"made.{field}").alias(name) for field, name in names.items()])


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` in the column ``out``, which replaces one of that name."""
    tables = shared(docs.sparkSession, model)

    @F.arrow_udf("ids array<int>")
    def coded(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.concat_arrays([_lists(*tables.value.encode(texts)) for texts in blocks(column)])], ["ids"])

    return _replaced(docs, text_col, coded, {"ids": out})


def decode(docs: DataFrame, ids_col: str = "token_ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col`` in the column ``out``, which replaces one of that name."""
    tables = shared(docs.sparkSession, model)

    @F.arrow_udf("text string")
    def text(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([tables.value.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else None) for x in column], pa.string())], ["text"])

    return _replaced(docs, ids_col, text, {"text": out})


def encode_and_decode(docs: DataFrame, text_col: str = "text", model: str = MODEL, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one visit of a Python worker; the text is decoded from the ids alone."""
    tables = shared(docs.sparkSession, model)

    @F.arrow_udf("ids array<int>, text string")
    def both(column: pa.Array) -> pa.Array:
        coded, decoded = [], []
        for texts in blocks(column):
            found, counts = tables.value.encode(texts)
            ends = np.cumsum(counts).tolist()
            coded.append(_lists(found, counts))
            decoded.append(pa.array([tables.value.decode(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(coded), pa.concat_arrays(decoded)], ["ids", "text"])

    return _replaced(docs, text_col, both, {"ids": ids, "text": decoded})
