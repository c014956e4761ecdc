"""Secret scans over a trigram inverted index.

Every rule is a regular expression; a Boolean trigram query is derived from it. The index holds, for each trigram that
some query names, its postings: words of 64 documents, keyed by id // 64. Postings are intersected word by word,
which gives candidate documents for each rule; a candidate is verified with the rules themselves. A rule without mandatory
trigrams (the hexadecimal one) scans every document. Documents never shuffle: a Bloom filter of candidate ids, of bounded size, tells
which to verify. Its false positives, more of them where candidates are too many for it, are verified in vain and change nothing.

A span is (kind, start, end) in code points, end exclusive; matches of a kind are leftmost and don't overlap. Null
and empty texts have no spans. Rows with a null id can't be indexed and are verified against every rule. Rows that share an
id are candidates together and verified one by one. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.words import ascii_lower
from folioflow.llm import bitfilter, trigrams
from folioflow.plans.materialize import spill


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those shorter than ``least`` are dropped, measured on ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more are just the maximal runs that are long enough
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def queries_of(rules: tuple[Rule, ...]) -> dict[str, object]:
    """The trigram query of each rule; True where a rule must scan fully."""
    return {r.kind: trigrams.derive(r.pattern) for r in rules}


def build_index(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, block, docs): bit i of ``docs`` is the document with id 64 * block + i. Partially aggregated before the shuffle."""
    listed = F.array(*[F.lit(t) for t in names])
    low = ascii_lower(F.col(text_col))
    held = F.transform(F.array(low), lambda text: F.filter(listed, lambda t: F.contains(text, t)))[0]
    posted = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.explode(held).alias("trigram"), F.shiftright(F.col(id_col).cast("long"), 6).alias("block"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col(id_col).cast("long").bitwiseAND(63).cast("int")).alias("bit"),
    )
    return posted.groupBy("trigram", "block").agg(F.bit_or("bit").alias("docs"))


def _intersect(query, postings: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return postings[query]
    parts = [_intersect(q, postings) for q in query[1]]
    for p in parts[1:]:
        parts[0] = parts[0].bitwiseAND(p) if query[0] == "and" else parts[0].bitwiseOR(p)
    return parts[0]


def candidates(index: DataFrame, indexed: dict[str, object]) -> DataFrame:
    """(id, rules): documents that may match, bit r of ``rules`` for the r-th indexed rule."""
    names = sorted(set().union(*map(trigrams.vocabulary, indexed.values())))
    zero = F.lit(0).cast("long")
    words = index.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(F.col("trigram") == t, F.col("docs"))), zero).alias(f"t{i}") for i, t in enumerate(names)])
    postings = {t: F.col(f"t{i}") for i, t in enumerate(names)}
    hits = words.select("block", *[_intersect(q, postings).alias(f"r{k}") for k, q in enumerate(indexed.values())])
    of_bit = lambda word, i: F.call_function("shiftright", word, i).bitwiseAND(1)
    each = hits.filter(" OR ".join(f"r{k} != 0" for k in range(len(indexed)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rules = zero
    for k in range(len(indexed)):
        rules = rules.bitwiseOR(F.call_function("shiftleft", of_bit(F.col(f"r{k}"), F.col("i")), F.lit(k)))
    return each.select((F.col("block") * 64 + F.col("i")).alias("id"), rules.alias("rules")).filter("rules != 0")


SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule in a text: the lengths of matches, and of what ``split`` leaves between them, give the places."""
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g)).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = begin + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        keep = F.coalesce(F.char_length(x["part"]), F.lit(0)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """``docs`` with ``secret_spans``, which replaces a column of that name: array of (start, kind, end), kind being the place of the rule in ``rules``, sorted."""
    derived = queries_of(rules)
    indexed = {k: q for k, q in derived.items() if q is not True}
    names = sorted(set().union(set(), *map(trigrams.vocabulary, indexed.values())))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    packed = packed.select("doc", F.col(f"doc.`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")).alias("body"))
    if indexed:
        index = spill(build_index(docs, names, id_col, text_col), "trigram-index")
        found = spill(candidates(index, indexed), "trigram-candidates")
        bits = bitfilter.bits_for(found.count(), max_bits)
        probed = bitfilter.probe(packed, bitfilter.present(found.select("id"), bits), F.col("id"), bits, "maybe")
        packed = probed.select("doc", "body", (F.col("maybe") | F.col("id").isNull()).alias("candidate"))
    parts = []
    for order, rule in enumerate(rules):
        own = spans_of(F.col("body"), rule, order)
        parts.append(F.when(F.col("candidate"), own).otherwise(F.array().cast(SPAN)) if rule.kind in indexed else own)
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "secret_spans"]
    return packed.select(*kept, F.array_sort(F.concat(*parts)).alias("secret_spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
