"""Fetching what isn't there yet: bodies and files of documents, over http or from folders.

Only what is missing is asked for: an anti join with what is kept comes before the requests. Requests run in a few tasks that
wait between them. What can't be had is reported, not an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators.blocks import body_html, page_parts
from folioflow.operators.store import dated, unfetched
from folioflow.plans.materialize import spill
from folioflow.sources.crawl import AGENT, fetch
from folioflow.sources.files import is_pdf


def fetched(todo: DataFrame, url_col: str, tasks: int = 3, delay: float = 0.4, agent: str = AGENT) -> DataFrame:
    """``todo`` with ``content``: the bytes behind ``url_col``, null where it is null or can't be had."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):  # one at a time: a task holds one body
                row = frame.iloc[at : at + 1].copy()
                url = row[url_col].iat[0]
                row["content"] = [fetch(url, agent) if isinstance(url, str) else None]
                yield row
                if delay and isinstance(url, str) and not url.startswith("file:"):
                    time.sleep(delay)

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields)
    return todo.repartition(tasks).mapInPandas(run, f"{named}, content binary")


def readable(column: str) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def bodies(docs: DataFrame, kept: DataFrame | None = None, **how) -> DataFrame:
    """(key, html): the body tables of circulars that have none yet and aren't in ``kept`` (key); pages without one give no row."""
    todo = docs.filter("doc_type = 'circular' AND body_path IS NULL").select("key", "source_url")
    if kept is not None:
        todo = unfetched(todo, kept.select("key").distinct())
    got = fetched(todo, "source_url", **how).select("key", readable("content").alias("page"))
    return got.select("key", body_html(F.col("page")).alias("html")).filter("html IS NOT NULL")


def resolved(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``pdf_url``: where it is missing, the document link of the page behind ``source_url``."""
    pages = fetched(docs.filter("pdf_url IS NULL").drop("pdf_url"), "source_url", **how)
    found = pages.withColumn("pdf_url", X.pick_link(page_parts(readable("content"))["hrefs"])).drop("content")
    return docs.filter("pdf_url IS NOT NULL").unionByName(found)


def downloads(docs: DataFrame, **how) -> DataFrame:
    """(key, pdf_url, year, month, name, content, outcome) for documents without a file. ``content`` is kept only if it is a PDF.

    The outcome is saved, no link, failed, or not a pdf: hosts that answer with a page of their own under such a name.
    """
    todo = docs.filter("local_path IS NULL").select("key", "number", "subject", "issue_date", "source_url", "pdf_url")
    got = fetched(resolved(todo, **how), "pdf_url", **how)
    good = F.coalesce(is_pdf(F.col("content")), F.lit(False))
    outcome = F.when(F.col("pdf_url").isNull(), "no link").when(F.col("content").isNull(), "failed").when(~good, "not a pdf").otherwise("saved")
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    name = F.concat(X.safe_name(F.coalesce(some("number"), some("subject"), F.col("key"))), F.lit(".pdf"))
    return dated(got).select("key", "pdf_url", "year", "month", name.alias("name"), F.when(good, F.col("content")).alias("content"), outcome.alias("outcome"))


def download(docs: DataFrame, path: str, **how) -> DataFrame:
    """Keep the files of documents under ``path`` by year and month; returns (key, pdf_url, local_path, outcome), local_path null unless saved."""
    got = spill(downloads(docs, **how), "downloads")
    got.filter("outcome = 'saved'").select("key", "name", "content", "year", "month").write.mode("append").partitionBy("year", "month").parquet(path)
    where = F.concat_ws("/", F.lit(path.rstrip("/")), F.concat(F.lit("year="), "year"), F.concat(F.lit("month="), "month"), "name")
    return got.select("key", "pdf_url", F.when(F.col("outcome") == "saved", where).alias("local_path"), "outcome")
