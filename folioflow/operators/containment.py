"""Which texts contain which quotes, case and white space aside: a theta join made an equi-join.

Inside a quote all words but the first and last are whole words of any text that contains it. A quote of enough words has one or more runs of ``KEY_WORDS`` whole
words; in how many texts each run stands is counted, over the runs of quotes alone, and the rarest is the quote's key: a quote with a run that no text has is in no text. Quotes and
texts meet on keys and are confirmed. Texts are read once for the runs, once more to confirm; a run in very many texts is a key only of quotes that have no rarer one.
Quotes too short for a run are the literals of one automaton, see ``multimatch``: one pass over the texts at any number of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import norm
from folioflow.operators.multimatch import matches
from folioflow.plans.materialize import spill

KEY_WORDS = 4


def _runs(words: Column) -> Column:
    """Hashes of the different runs of KEY_WORDS words."""
    n = F.size(words)
    at = F.when(n >= KEY_WORDS, F.sequence(F.lit(1), n - KEY_WORDS + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(words, i, KEY_WORDS))))


def containment(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str) -> DataFrame:
    """(text_id, quote_id) for texts (text_id, text) and quotes (quote_id, text); an empty quote is in no text."""
    t = texts.select(F.col(text_id).alias("text_id"), norm(F.col("text")).alias("text"))
    q = quotes.select(F.col(quote_id).alias("needle_id"), norm(F.col("text")).alias("quote")).filter(F.char_length("quote") > 0)
    q = spill(q.withColumn("words", F.split("quote", " ")), "quotes")
    has_key = F.size("words") >= KEY_WORDS + 2
    n_long, n_short = q.agg(F.count_if(has_key), F.count_if(~has_key)).first()
    found = []
    if n_long:
        found.append(by_rarest_run(t, q.filter(has_key)))
    if n_short:
        short = q.filter(~has_key).select("needle_id", F.array("quote").alias("literals"), F.lit(None).cast("string").alias("pattern"))
        found.append(matches(t, short))
    if not found:
        found.append(t.crossJoin(q).limit(0).select("text_id", "needle_id"))
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return met.distinct().select(F.col("text_id").alias(text_id), F.col("needle_id").alias(quote_id))


def by_rarest_run(t: DataFrame, long: DataFrame) -> DataFrame:
    """(text_id, needle_id) of quotes with whole runs: ``long`` has needle_id, quote, words; ``t`` has text_id, text."""
    inner = F.slice("words", 2, F.size("words") - 2)
    of_quotes = spill(long.select("needle_id", inner.alias("words")).select("needle_id", F.explode(_runs(F.col("words"))).alias("run")), "quote-runs")
    # the words are a column of their own: inside the function of places they would be split once per place
    spread = t.select("text_id", F.split("text", " ").alias("words")).select("text_id", F.explode(_runs(F.col("words"))).alias("run"))
    of_texts = spill(spread.join(of_quotes.select("run").distinct(), "run", "left_semi"), "text-runs")
    often = of_texts.groupBy("run").agg(F.count("*").alias("n"))
    ranked = of_quotes.join(often, "run", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("key"))
    keys = spill(ranked.filter("key.n > 0").select("needle_id", F.col("key.run").alias("run")), "quote-keys")
    pairs = of_texts.join(keys, "run").select("text_id", "needle_id").distinct()
    return pairs.join(long.select("needle_id", "quote"), "needle_id").join(t, "text_id").filter(F.contains("text", F.col("quote"))).select("text_id", "needle_id")
