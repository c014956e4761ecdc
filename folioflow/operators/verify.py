"""Checking quoted citations against the sources they name, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import norm


def verify(citations: Column, texts: Column, numbers: Column) -> Column:
    """One result per citation: ok (the quote is in the cited source), wrong_source (in another one) or not_found.

    ``found_in`` lists every source that holds the quote, counted from 1; an empty quote is in none. Case and white space don't matter.
    """
    normed = F.transform(texts, norm)

    def one(c: Column, sources: Column) -> Column:
        quote = norm(c["quote"])
        places = F.transform(sources, lambda t, i: F.when((F.char_length(quote) > 0) & F.contains(t, quote), i + 1))
        found = F.array_compact(places)
        cited = F.coalesce(F.array_contains(found, c["source_id"].cast("int")), F.lit(False))
        status = F.when(cited, "ok").when(F.size(found) > 0, "wrong_source").otherwise("not_found")
        inside = c["source_id"].between(1, F.size(sources))
        return F.struct(
            c["source_id"].cast("int").alias("source_id"), c["quote"].alias("quote"), status.alias("status"), found.alias("found_in"),
            F.when(inside, F.get(numbers, (c["source_id"] - 1).cast("int"))).alias("cited_doc"),
        )

    return F.transform(F.array(normed), lambda sources: F.transform(citations, lambda c: one(c, sources)))[0]


def verified(checks: Column) -> Column:
    """How many citations are ok."""
    return F.size(F.filter(checks, lambda c: c["status"] == "ok"))
