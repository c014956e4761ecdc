"""The prefix trie and the repair of turns against brute force; nulls, ties, repeated rows, empty tables, clashing names, long conversations."""

import hashlib
import itertools
import random
import zlib

import pytest
from folioflow.llm import prefix_trie, turn_repair

DDL = "conv_id long, turn long, role string, text string, base string, digest int, key int, gone boolean, copy int, words int"
COLUMNS = ["conv_id", "turn", "role", "text"]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, None, 5, 6) for r in rows], DDL).repartition(parts)


def random_rows(seed, ids, most=6):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", "", None]), rng.choice(["a b.", "c", "", None, "ä ö ü!"])))
    return rows + rng.sample(rows, len(rows) // 8)


def plain_trie(rows):
    """Nodes from all prefixes of all rebuilt conversations."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            talks.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    talks = {c: [(t[3], t[4]) for t in sorted(own)] for c, own in talks.items()}
    paths = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(talks.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [v for v in nodes if v[: len(node)] == node]
        leaf = lambda v: not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in nodes)
        words = lambda v: len(v[-1][1].split()) if v else 0
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == node)))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(v) == len(node) + 1 for v in below), sum(map(leaf, below)),
            sum((len(nodes[v]) - 1) * words(v) for v in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def trie_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_all_prefixes(spark, seed):
    """Few texts, so that families share nodes at every depth; negative ids, absent bases, ids left without turns."""
    ids = [i for i in range(-45, 130) if i % 3 or i % 20 == 0][:: seed + 1] + [None]
    rows = random_rows(seed, [i for i in ids if i != 40])
    assert trie_rows(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(rows)


@pytest.mark.parametrize("most", [12, 0])
def test_long_families_are_dealt(spark, monkeypatch, most):
    """Families cut into slices of two turns, beside others that a task holds, or all of them: the same trie."""
    monkeypatch.setattr(prefix_trie, "LONG", most)
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    rows = random_rows(9, [i for i in range(-25, 90) if i % 4 == 0 or i < 30], most=5)
    assert trie_rows(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(rows)


def test_ends_of_many_families(spark):
    """A conversation in very many families: its ends lie in many blocks and are hashed as one list."""
    rows = [(c, 0, "user", "same question") for c in range(0, 900, 20)]
    rows += [(c + 1, t, "user", f"own {c}") for c in range(0, 900, 20) for t in range(2)]
    assert trie_rows(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(rows)
    families = spark.createDataFrame([(b, bytearray(b"k" * 16), f"{b},{b + 1}") for b in range(-400, 4000, 20)], "base long, key binary, ends string")
    (row,) = prefix_trie.shared_ends(families, families.select("key").distinct(), block=7).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(f"{b},{b + 1}" for b in range(-400, 4000, 20)).encode()).hexdigest()


def test_trie_of_nothing_and_of_long_conversations(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(20, t, "user", f"turn {t}") for t in range(3000)] + [(21, t, "user", f"turn {t}") for t in range(2999)]
    got = {r.depth: r for r in prefix_trie.prefix_trie(table(spark, rows)).collect()}
    assert len(got) == 3001 and got[2999].n_convs == 2 and got[3000].n_convs == 1 and got[0].saved_tokens == 2 * 2999 and got[0].n_leaves == 1


# ---- repair


def every_audit(rows):
    """(cost, audit) of the least edits, from all strings of edits over the rows."""
    best = None

    def walk(at, state, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and state in (0, 3):
            best = min(best, (cost, audit)) if best else (cost, audit)
        grammar = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}][state]
        for into in {grammar[i] for i in grammar if i in "ua"}:
            if cost + 2 <= 3 * len(rows):
                walk(at, into, cost + 2, audit + "I")
        if at < len(rows):
            initial, fault = rows[at]
            walk(at + 1, state, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                for into in {grammar[i] for i in grammar if i in "ua"}:
                    walk(at + 1, into, cost + 2 + late, audit + "R")
                if initial in grammar:
                    walk(at + 1, grammar[initial], cost + late, audit + "K")

    walk(0, 0, 0, "")
    return best


def test_audits_are_the_least_of_all():
    rng = random.Random(5)
    for n in range(6):
        for _ in range(40):
            rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]
            assert turn_repair.cheapest(rows) == every_audit(rows), rows


def test_trails_are_ordered_as_strings():
    """As in the search, a trail is continued once with each letter."""
    rng = random.Random(1)
    trails, continued = [turn_repair.Trail()], set()
    while len(trails) < 300:
        parent, letter = rng.choice(trails[-12:]), rng.choice("DIKR")
        if (id(parent), letter) not in continued:
            continued.add((id(parent), letter))
            trails.append(turn_repair.Trail(parent, letter))
    for a, b in itertools.product(trails[::7], trails):
        assert (a < b) == (str(a) < str(b))


def plain_repair(rows):
    talks, spaced = {}, lambda v: " " if v is None else str(v)
    for c, turn, role, text in rows:
        own = talks.setdefault(c, [])
        k = zlib.crc32(f"{spaced(c)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if k == 4 else spaced(role), spaced(text)
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        own += [(turn is not None, turn or 0, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, own in talks.items():
        own.sort()
        seen, fault = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = every_audit([(r[2][:1], f) for r, f in zip(own, fault, strict=True)])
        lines, left, lead = [], list(own), None
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter == "D":
                continue
            lead = (letter == "K" and row[2][:1] == "s") if lead is None else lead
            made = "user" if (len(lines) - lead) % 2 == 0 else "assistant"
            lines.append((row[2] if letter == "K" else made) + ":" + (row[3] if row else ""))
        known = {t for has, t, _, _ in own if has}
        gap = max(known) - min(known) + 1 - len(known) if known else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        out.append((c, gap, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def repaired(df):
    return sorted(str(tuple(r)) for r in turn_repair.repair(df).drop("turns").collect())


@pytest.mark.parametrize(("most", "block"), [(3, 2), (0, 1)])
def test_long_conversations_are_dealt(spark, monkeypatch, most, block):
    """Conversations cut into blocks, beside others that a task holds, or all of them: the same repairs."""
    monkeypatch.setattr(turn_repair, "LONG_ROWS", most)
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    rows = random_rows(12 + most, [*range(50), None], most=6)
    assert repaired(turn_repair.damage(table(spark, rows))) == plain_repair(rows)


def test_blocks_add_up():
    """Through any cut, the prices of two parts make the price of the whole."""
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice([None, "truncated", "blank"])) for _ in range(rng.randint(2, 9))]
        cut = rng.randrange(1, len(rows))
        for entry in range(4):
            one, two = turn_repair.prices(rows[:cut], entry), [turn_repair.prices(rows[cut:], s) for s in range(4)]
            for end, whole in enumerate(turn_repair.prices(rows, entry)):
                ways = [one[s] + two[s][end] for s in range(4) if one[s] >= 0 and two[s][end] >= 0]
                assert whole == min(ways, default=-1)


def test_repair_equals_all_edits(spark):
    rows = random_rows(7, [*range(60), None], most=5)
    assert repaired(turn_repair.damage(table(spark, rows))) == plain_repair(rows)


def test_repair_of_nothing_and_of_long_conversations(spark):
    assert turn_repair.repair(turn_repair.damage(table(spark, []))).count() == 0
    rows = [(7, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(20_000)] + [(8, 0, "user", "é" * 300_000 + ".")]
    got = {r.conv_id: r for r in turn_repair.repair(table(spark, rows)).collect()}
    assert got[7].cost == 4 and got[7].audit == "I" + "K" * 20_000 + "I" and len(got[7].turns) == 20_002
    assert got[8].audit == "KI" and got[8].turns[0].text == "é" * 300_000 + "."
