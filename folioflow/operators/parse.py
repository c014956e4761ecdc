"""Pages to rows of the docs table. The HTML is read once by a UDF; everything after that is built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import dictionaries as D
from folioflow.functions import text as X
from folioflow.operators.blocks import page_parts

DOC_COLUMNS = [
    "key", "doc_type", "rbi_id", "number", "issue_date", "raw_date", "department", "ref_code", "meant_for", "applies_to", "subject", "source_url", "pdf_url", "local_path", "fetched_at",
]


def _empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_paragraphs(pages: DataFrame, clock: Column) -> DataFrame:
    """Rows of docs from (rbi_id, paragraphs, hrefs). Pages without a circular number in a paragraph are dropped."""
    p = F.col("paragraphs")
    df = pages.withColumn("head", F.array_position(F.transform(p, lambda t: t.rlike(D.NUMBER_PATTERN)), True)).filter("head > 0")
    first = F.get(p, (F.col("head") - 1).cast("int"))
    df = df.withColumn("number", X.number_of(first))
    ref = F.trim(F.substring(first, F.instr(first, F.col("number")) + F.char_length("number"), F.lit(1 << 30)))
    df = df.withColumn("ref_code", _empty_to_null(ref))
    # the date is in one of the three paragraphs after the number
    near = F.transform(F.slice(p, F.col("head").cast("int") + 1, 3), lambda t, i: F.struct(i.alias("i"), X.raw_date(t).alias("raw"), X.iso_date(t).alias("iso")))
    df = df.withColumn("dated", F.get(F.filter(near, lambda d: d["raw"].isNotNull()), F.lit(0)))
    after = (F.col("head") + F.coalesce(F.col("dated.i") + 1, F.lit(0))).cast("int")
    kind = lambda t: F.when(t.rlike(f"(?iu){D.ADDRESSEE_PATTERN}"), "to").when(t.rlike(f"(?iu){D.SKIP_PATTERN}") | (F.char_length(t) < 12), "skip").otherwise("subject")
    df = df.withColumn("lines", F.transform(F.slice(p, after + 1, 7), lambda t: F.struct(kind(t).alias("kind"), t.alias("text"))))
    at = F.array_position(F.transform("lines", lambda x: x["kind"]), "subject").cast("int")
    before = F.when(at > 0, F.slice("lines", 1, at - 1)).otherwise(F.col("lines"))
    addressee = F.array_join(F.transform(F.filter(before, lambda x: x["kind"] == "to"), lambda x: x["text"]), " ")
    df = df.withColumn("subject", F.when(at > 0, F.substring(F.get(F.col("lines"), at - 1)["text"], 1, 400)))
    df = df.withColumn("meant_for", _empty_to_null(F.substring(addressee, 1, 300)))
    return df.select(
        F.concat(F.lit("circular:"), F.col("rbi_id").cast("string")).alias("key"), F.lit("circular").alias("doc_type"), F.col("rbi_id").cast("long").alias("rbi_id"), "number",
        F.col("dated.iso").alias("issue_date"), F.col("dated.raw").alias("raw_date"), X.department(F.col("number"), F.col("ref_code")).alias("department"), "ref_code", "meant_for",
        X.applies_to(F.col("subject"), F.col("meant_for")).alias("applies_to"), "subject", F.concat(F.lit(D.DETAIL_URL), F.col("rbi_id").cast("string")).alias("source_url"),
        X.pick_link(F.col("hrefs")).alias("pdf_url"), F.lit(None).cast("string").alias("local_path"), clock.alias("fetched_at"),
    )


def parse_circulars(pages: DataFrame, clock: Column, id_col: str = "rbi_id", html_col: str = "html", stop_before: str | None = None) -> DataFrame:
    """Rows of docs from (id, html). Rows dated before ``stop_before`` go; rows without a date stay."""
    parts = pages.select(F.col(id_col).alias("rbi_id"), page_parts(F.col(html_col)).alias("x")).filter("x.has_body")
    docs = parse_paragraphs(parts.select("rbi_id", "x.paragraphs", "x.hrefs"), clock)
    return docs if stop_before is None else docs.filter(F.col("issue_date").isNull() | (F.col("issue_date") >= stop_before))


def parse_directions(listing: DataFrame, clock: Column, base: str, html_col: str = "html") -> DataFrame:
    """Rows of docs from listing pages: anchors that name a master direction, dated by the text around them."""
    a = listing.select(F.explode(page_parts(F.col(html_col))["anchors"]).alias("a")).select("a.*").filter(F.char_length("text") >= 12)
    named = F.contains("href", F.lit("MasterDirection")) | F.contains(F.replace("text", F.lit(" "), F.lit("")), F.lit("MasterDirection")) | F.contains("text", F.lit("Master Direction"))
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/+", "")))
    none = F.lit(None).cast("string")
    return a.filter(named).select(
        F.concat(F.lit("md:"), F.pmod(F.xxhash64(url), F.lit(1_000_000_000)).cast("string")).alias("key"), F.lit("master_direction").alias("doc_type"), F.lit(None).cast("long").alias("rbi_id"),
        none.alias("number"), X.iso_date(F.col("row_text")).alias("issue_date"), X.raw_date(F.col("row_text")).alias("raw_date"), none.alias("department"), none.alias("ref_code"),
        F.lit("Master Direction").alias("meant_for"), X.scan_entities(F.col("text")).alias("applies_to"), F.col("text").alias("subject"), url.alias("source_url"), none.alias("pdf_url"),
        none.alias("local_path"), clock.alias("fetched_at"),
    )
