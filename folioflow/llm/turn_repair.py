"""Repair of the turn structure of conversations at the least cost.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A row's first fault counts: blank (no text but white
space), duplicate (an earlier row has its role and text), truncated (its last character that isn't white space is none of ``.!?``). Edits:

- K keeps a row at no cost, R gives it the role user or assistant for 2; either costs 1 more if the row is truncated;
- D deletes a row for 3; blank and duplicate rows must go;
- I inserts a row of user or assistant without text for 2.

The edits are the shortest path through the lattice of (rows used up, state of the grammar). It is searched by Dijkstra's method without laying the lattice
out; the key of the queue is (cost, audit), the audit being the initials of the edits so far, and the first accepting node at the end that
leaves the queue ends the search. Two audits of one cost that meet in a node are never the start of one another (they use up the same rows, so the longer
would hold more insertions and cost more): the order by (cost, audit) survives whatever follows, as the method needs.
Audits are chains of nodes with jump pointers, compared in logarithmic time: a conversation of n rows takes n log n steps and memory in proportion to n.

Rows are sorted by conversation inside their partitions and streamed: a task holds one conversation at a time. Conversations of more than ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes, found by
a count that is aggregated before its shuffle, are dealt over blocks of ``BLOCK_ROWS`` rows instead. What it costs to get from each state of the grammar to each through a block needs no other block;
what it then costs to the end, from the state in which a block is left, follows from those few numbers. With that as the price of leaving, each block is searched from each state it may be entered
in; no insertion stands at the end of a block but the last, so again no audit is the start of another. Which of the searches holds is a walk from block to block. Places are numbered by ranges of
rows, repeated rows are found by grouping, and the digest streams the repaired lines in order.

Nulls in any column count as one space (a null turn comes first, a null id is a conversation of its own); rows of equal turn go by role, then text;
repeated rows are rows. Roles go by their first character: an empty one is none of s, u, a. Texts of any length stay whole. Other columns are ignored.
An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.plans.materialize import spill

SPACES = " \t\n\v\f\r"
ENDS = ".!?"
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row; what each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role an insertion or a new role must have in each state: no edit makes a system row.
MADE = ("user", "user", "assistant", "user")
ACCEPTING = (START, ASSISTANT)
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

CONVERSATION = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "turns array<struct<role:string,text:string>>"
)
SHIP_BYTES = 2 << 20
LONG_ROWS, LONG_BYTES = 50_000, 64 << 20
BLOCK_ROWS = 5_000


class Trail:
    """A string that grows by a letter at its end and shares all before it; ordered as strings are."""

    __slots__ = ("length", "letter", "parent", "jump")

    def __init__(self, parent: Trail | None = None, letter: str = ""):
        self.parent, self.letter = parent or self, letter
        self.length = parent.length + 1 if parent else 0
        if parent is None:
            self.jump = self
        else:
            far = parent.jump
            self.jump = far.jump if parent.length - far.length == far.length - far.jump.length else parent

    def __lt__(self, other: Trail) -> bool:
        a, b = self, other
        while a.length > b.length:
            a = a.jump if a.jump.length >= b.length else a.parent
        while b.length > a.length:
            b = b.jump if b.jump.length >= a.length else b.parent
        if a is b:
            return self.length < other.length
        while a.parent is not b.parent:  # equal lengths jump equally far
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, at = [], self
        while at.length:
            letters.append(at.letter)
            at = at.parent
        return "".join(reversed(letters))


def cheapest(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows given as (initial of the role, fault); of equal ones the audit least in ASCII order."""
    return search(rows, START, dict.fromkeys(ACCEPTING, 0))[:2]


def search(rows: list[tuple[str, str | None]], entry: int, exits: dict[int, int], last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the cheapest edits from the state ``entry``; ``exits`` are the states to end in and what each of them still costs.

    Insertions after the last row are for the ``last`` block of a conversation alone.
    """
    queue: list[tuple[int, Trail, int, int]] = [(0, Trail(), 0, entry)]
    done = set()
    while True:
        cost, trail, at, state = heapq.heappop(queue)
        if at > len(rows):
            return cost, str(trail), state
        if (at, state) in done:
            continue
        done.add((at, state))
        edits = []
        if at == len(rows) and state in exits:
            heapq.heappush(queue, (cost + exits[state], trail, at + 1, state))
        made = NEXT[state][MADE[state][0]]
        if last or at < len(rows):
            edits.append((INSERT, "I", at, made))
        if at < len(rows):
            initial, fault = rows[at]
            edits.append((DELETE, "D", at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                late = CUT if fault == TRUNCATED else 0
                edits.append((REROLE + late, "R", at + 1, made))
                if initial in NEXT[state]:
                    edits.append((late, "K", at + 1, NEXT[state][initial]))
        for price, letter, then, into in edits:
            if (then, into) not in done:
                heapq.heappush(queue, (cost + price, Trail(trail, letter), then, into))


def faults(turns: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text) of a conversation in order."""
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACES)
        out.append(BLANK if not bare else DUPLICATE if (role, text) in seen else None if bare[-1] in ENDS else TRUNCATED)
        seen.add((role, text))
    return out


def replay(turns: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The rows that the edits of an audit leave, from a state of the grammar on."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append((MADE[state], ""))
        elif letter == "R":
            out.append((MADE[state], turns[at][1]))
        elif letter == "K":
            out.append(turns[at])
        at += letter != "I"
        if letter != "D":
            state = NEXT[state][out[-1][0][:1]]
    return out


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def mended(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """The report of one conversation given as (turn, role, text) in order; its last part are the repaired rows."""
    turns = [(role, text) for _, role, text in rows]
    fault = faults(turns)
    cost, audit = cheapest([(role[:1], f) for (role, _), f in zip(turns, fault, strict=True)])
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in pairwise(turns))
    left = replay(turns, audit)
    digest = hashlib.sha256("\n".join(line(*t) for t in left).encode()).hexdigest()
    return conv_id, gaps([t for t, _, _ in rows]), fault.count(BLANK), fault.count(DUPLICATE), fault.count(TRUNCATED), illegal, cost, audit, digest, left


def line(role: str, text: str) -> str:
    return f"{role}:{text}"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of damaged rows; a dropped row stays as ``gone`` without its text, so that its conversation is known.

    The crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat_ws(":", spaced("conv_id"), spaced("turn")), "UTF-8")) % 20
    text = F.when(k <= 1, "").when(k == 2, F.translate(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    rows = conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), k.alias("k"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.withColumn("copy", copies).select("conv_id", "turn", "role", "text", (F.col("k") == 0).alias("gone"))


def _in_order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text and optionally gone): its faults, cost, audit, the digest of the repaired lines and the repaired turns.

    Of a conversation that no task holds the turns are null; ``repaired_lines`` has them in pieces.
    """
    rows = _read(turns)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    sizes = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = spill(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("key"), "repair-long")
    if long.isEmpty():
        return _repair_held(rows)
    keyed = rows.withColumn("key", key)
    return _repair_held(keyed.join(long, "key", "left_anti").drop("key")).unionByName(_repair_long(keyed.join(long, "key", "left_semi")))


def _read(turns: DataFrame) -> DataFrame:
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), F.coalesce(gone, F.lit(False)).alias("gone"))


def _repair_held(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*_in_order()).mapInArrow(_mend_all, CONVERSATION)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _mend_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reports of sorted rows, in batches of bounded size."""
    out, held = [], 0
    for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
        out.append(mended(conv_id, [r[1:4] for r in rows if not r[4]]))
        held += 200 + sum(len(role) + len(text) for role, text in out[-1][-1])
        if held > SHIP_BYTES:
            yield _shipped(out)
            out, held = [], 0
    if out:
        yield _shipped(out)


_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)


def _shipped(reports: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*reports, strict=True))
    columns[-1] = [[{"role": role, "text": text} for role, text in turns] for turns in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


# ---- conversations that no task holds


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their place in the conversation from 0 on, and the block of that place: ranges of rows in order are counted first, then numbered inside each."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows have no order; one range needn't hold them all
    ranged = spill(salted.repartitionByRange("key", *order, "salt").withColumn("range", F.spark_partition_id()).drop("salt"), "repair-ranges")
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("key", "range").count().select("key", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = ranged.withColumn("at", F.row_number().over(W.partitionBy("key", "range").orderBy(*order)))
    placed = inside.join(counts, ["key", "range"]).withColumn("pos", F.col("start") + F.col("at") - 1).drop("range", "start", "at")
    return placed.withColumn("block", F.floor(F.col("pos") / BLOCK_ROWS))


def _faulty(placed: DataFrame) -> DataFrame:
    """``placed`` with the fault of each row."""
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = spill(placed.withColumn("digest", digest), "repair-placed")
    firsts = spill(rows.groupBy("key", "role", "digest").agg(F.min("pos").alias("first")), "repair-firsts")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(*ENDS), TRUNCATED)
    return rows.join(firsts, ["key", "role", "digest"]).withColumn("fault", fault).drop("digest", "first")


def prices(rows: list[tuple[str, str | None]], entry: int) -> list[int]:
    """The least cost from a state before some rows to each state right after the last of them; -1 where there is no way."""
    far = 1 << 60
    cost = [far] * 4
    cost[entry] = 0
    for initial, fault in rows:
        cost[USER] = min(cost[USER], min(cost[START], cost[SYSTEM], cost[ASSISTANT]) + INSERT)
        cost[ASSISTANT] = min(cost[ASSISTANT], cost[USER] + INSERT)
        then = [c + DELETE for c in cost]
        if fault not in (BLANK, DUPLICATE):
            late = CUT if fault == TRUNCATED else 0
            for state in range(4):
                made = NEXT[state][MADE[state][0]]
                then[made] = min(then[made], cost[state] + REROLE + late)
                if initial in NEXT[state]:
                    into = NEXT[state][initial]
                    then[into] = min(then[into], cost[state] + late)
        cost = then
    return [c if c < far else -1 for c in cost]


#: What is inserted after the last row in each state, to end well.
TAIL = ("", "II", "I", "")


def _price_block(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("pos", "initial", "fault")), strict=True))
    coded = [r[1:] for r in rows]
    initials = [r[0] for r in coded]
    return pa.Table.from_pylist([{
        "key": table["key"][0].as_py(), "block": table["block"][0].as_py(), "prices": [p for entry in range(4) for p in prices(coded, entry)],
        "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in pairwise(initials)),
    }], schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("prices", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]))


def _price_ends(table: pa.Table) -> pa.Table:
    """From the few numbers of each block of a conversation: what each state costs to the end where a block ends, and the illegal neighbours."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["block"])
    left = [INSERT * len(TAIL[state]) for state in range(4)]
    out = []
    for b in reversed(blocks):
        out.append({"key": b["key"], "block": b["block"], "left": left, "final": b is blocks[-1]})
        left = [min((b["prices"][4 * s + t] + left[t] for t in range(4) if b["prices"][4 * s + t] >= 0 and left[t] >= 0), default=-1) for s in range(4)]
    illegal = sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in pairwise(blocks))
    return pa.Table.from_pylist([x | {"illegal": illegal, "cost": left[START]} for x in out], schema=_ENDS)


_ENDS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("left", pa.list_(pa.int64())), ("final", pa.bool_()), ("illegal", pa.int64()), ("cost", pa.int64())])


def _search_block(key: tuple, table: pa.Table, ends: pa.Table) -> pa.Table:
    rows = [r[1:] for r in sorted(zip(*(table[c].to_pylist() for c in ("pos", "initial", "fault")), strict=True))]
    (end,) = ends.to_pylist()
    exits = {state: cost for state, cost in enumerate(end["left"]) if cost >= 0}
    found = [search(rows, entry, exits, last=False) for entry in range(4)]
    audits = [audit + (TAIL[state] if end["final"] else "") for _, audit, state in found]
    return pa.Table.from_pylist([{"key": key[0].as_py(), "block": key[1].as_py(), "exits": [f[2] for f in found], "audits": audits}], schema=_FOUND)


_FOUND = pa.schema([("key", pa.string()), ("block", pa.int64()), ("exits", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _walk(table: pa.Table) -> pa.Table:
    """The state in which each block of a conversation is entered."""
    state, out = START, []
    for block, exits in sorted(zip(table["block"].to_pylist(), table["exits"].to_pylist(), strict=True)):
        out.append({"key": table["key"][0].as_py(), "block": block, "entry": state})
        state = exits[state]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.int64())]))


def _lines_of_block(key: tuple, table: pa.Table, edits: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("pos", "role", "text")), strict=True))
    (edit,) = edits.to_pylist()
    lines = [line(*t) for t in replay([r[1:] for r in rows], edit["audit"], edit["entry"])]
    return pa.table({"key": [key[0].as_py()] * len(lines), "block": [key[1].as_py()] * len(lines), "n": list(range(len(lines))), "line": lines}, schema=_LINES)


_LINES = pa.schema([("key", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("line", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of sorted lines."""
    rows = (row for batch in batches for row in zip(batch["key"].to_pylist(), batch["line"], strict=True))
    for key, run in groupby(rows, key=lambda r: r[0]):
        digest, joint = hashlib.sha256(), b""
        for _, text in run:
            digest.update(joint)
            digest.update(text.as_py().encode())
            joint = b"\n"
        yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})


def _edits(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, block, entry, audit) of each block, and (key, illegal, cost) of each conversation."""
    thin = coded.select("key", "block", "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    priced = thin.groupBy("key", "block").applyInArrow(_price_block, "key string, block long, prices array<long>, first string, last string, illegal long")
    ends = spill(priced.groupBy("key").applyInArrow(_price_ends, "key string, block long, left array<long>, final boolean, illegal long, cost long"), "repair-ends")
    right = ends.select(F.col("key").alias("of_key"), F.col("block").alias("of_block"), "left", "final")
    found = thin.groupBy("key", "block").cogroup(right.groupBy("of_key", "of_block")).applyInArrow(_search_block, "key string, block long, exits array<long>, audits array<string>")
    found = spill(found, "repair-found")
    entries = found.select("key", "block", "exits").groupBy("key").applyInArrow(_walk, "key string, block long, entry long")
    edits = found.join(entries, ["key", "block"]).select("key", "block", "entry", F.get("audits", F.col("entry").cast("int")).alias("audit"))
    return spill(edits, "repair-edits"), ends.select("key", "illegal", "cost").distinct()


def repaired_lines(coded: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, block, n, line) of the repaired turns, block by block."""
    right = edits.select(F.col("key").alias("of_key"), F.col("block").alias("of_block"), "entry", "audit")
    rows = coded.select("key", "block", "pos", "role", "text")
    return rows.groupBy("key", "block").cogroup(right.groupBy("of_key", "of_block")).applyInArrow(_lines_of_block, "key string, block long, n long, line string")


def _repair_long(rows: DataFrame) -> DataFrame:
    rows = spill(rows, "repair-rows")
    live = rows.filter(~F.col("gone"))
    coded = spill(_faulty(_placed(live.drop("gone"))), "repair-coded")
    edits, costs = _edits(coded)
    audits = edits.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    digests = repaired_lines(coded, edits).repartition("key").sortWithinPartitions("key", "block", "n").select("key", "line").mapInArrow(_digests, "key string, repaired_sha256 string")
    known = live.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    faults = coded.groupBy("key").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)])
    found = rows.select("key", "conv_id").distinct()
    for part in (known, faults, costs, audits, digests):
        found = found.join(part, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", *[zero(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"), F.lit(None).cast("array<struct<role:string,text:string>>").alias("turns"),
    )
