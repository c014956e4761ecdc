"""Command line: ``python -m folioflow COMMAND``.

harvest            pages by id into the docs table; with --resume only ids it doesn't have
directions         listing pages, files or over http, into the docs table
download, text     files and bodies of documents that have none yet
organize           category folders and the CSV index
chunk [--stats]    bodies into chunks
build              chunks into the search collection
probe, entity-test, example   experiments on the collection
ask QUESTION, batch [--questions FILE], history, models

Settings in a file .env are added to the environment. ANSWER_URL, ANSWER_MODEL and ANSWER_KEY name a service that generates answers.
"""

from __future__ import annotations

import argparse
import os
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import config, tracing
from folioflow import dictionaries as D
from folioflow.operators import answer as A
from folioflow.operators import generate as G
from folioflow.operators import fetch as N
from folioflow.operators import ann, search, store
from folioflow.operators.blocks import blocks
from folioflow.operators.chunk import chunk, chunk_stats, class_counts, with_ids
from folioflow.operators.embed import HashingEmbedder, embed, embed_queries
from folioflow.operators.parse import parse_circulars, parse_directions
from folioflow.schemas import DOCS_DDL, migrate
from folioflow.session import session
from folioflow.sources.crawl import PagesById, fetch
from folioflow.sources.files import read_log


def chunks_of(spark: SparkSession, data: str) -> DataFrame:
    docs = spark.read.parquet(f"{data}/docs").filter(F.col("body_path").isNotNull())
    bodies = spark.read.parquet(f"{data}/bodies").select(F.col("key").alias("_key"), blocks("html").alias("blocks"))
    joined = docs.join(bodies, F.col("key") == F.col("_key")).withColumnRenamed("key", "doc_key")
    keep = ["doc_key", "rbi_id", "number", "ref_code", "issue_date", "department", "applies_to", "meant_for", "subject", "source_url"]
    return with_ids(chunk(joined.select(*keep, "blocks"), keep=keep))


def entity_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Questions with the class each asks about: lines of JSON (question, class), or one question a class of a short list."""
    if path:
        rows = spark.read.schema("question string, class string").json(path)
    else:
        rows = spark.createDataFrame([(f"Which rules bind {c}?", c) for c in D.ASKED_CLASSES], "question string, class string")
    return rows.withColumn("query_id", F.xxhash64("question", "class"))


def questions(spark: SparkSession, path: str | None = None, entity: list[str] | None = None) -> DataFrame:
    """The questions of a text file, one a line, or a short list."""
    lines = [r["value"] for r in spark.read.text(path).filter("trim(value) <> ''").toLocalIterator()] if path else D.SAMPLE_QUESTIONS
    return spark.createDataFrame([(i, q, entity) for i, q in enumerate(lines)], "query_id long, question string, entity array<string>")


def generator() -> G.Generator:
    """The service that the environment names, else the offline generator."""
    url = os.environ.get("ANSWER_URL")
    return G.RemoteGenerator(url, os.environ.get("ANSWER_MODEL", "remote"), os.environ.get("ANSWER_KEY")) if url else G.ExtractiveGenerator()


def entity_test(index: DataFrame, asked: DataFrame, k: int, find: Callable = search.topk) -> tuple[DataFrame, DataFrame]:
    """Precision without and with the filter, of the exact search or another one."""
    vectors = embed_queries(asked, HashingEmbedder())
    corpus = index.select(F.col("chunk_id").alias("id"), "embedding", "applies_to")
    none = F.lit(None).cast("array<string>")
    return tuple(search.precision(find(corpus, vectors.select("query_id", "embedding", c.alias("classes")), k), asked) for c in (none, F.array("class")))


def _write_swapped(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` itself reads: it is written aside first."""
    from folioflow.plans.materialize import spill

    spill(df, "swap").write.mode("overwrite").parquet(path)


def _docs(spark: SparkSession, data: str) -> DataFrame:
    """The docs table; an empty one where there is none yet. Any other trouble with reading it is an error."""
    try:
        return migrate(spark.read.parquet(f"{data}/docs"), DOCS_DDL)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return migrate(spark.range(0).select(F.lit(None).cast("string").alias("key")), DOCS_DDL)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="folioflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command", choices="harvest directions download text organize chunk build probe entity-test example ask batch history models".split())
    ap.add_argument("question", nargs="?")
    ap.add_argument("--data", default="data")
    ap.add_argument("--url", default=D.DETAIL_URL + "{id}")
    ap.add_argument("--start", default="13673")
    ap.add_argument("--back", default="700")
    ap.add_argument("--limit", type=int, default=500)
    ap.add_argument("--stop-before")
    ap.add_argument("--resume", action="store_true")
    ap.add_argument("--questions")
    ap.add_argument("--delay", type=float, default=0.4)
    ap.add_argument("--entity", action="append")
    ap.add_argument("--no-filter", action="store_true")
    ap.add_argument("--approximate", action="store_true", help="build: an index of lists and codes too; entity-test, example: search by it")
    ap.add_argument("--stats", action="store_true")
    ap.add_argument("--all", action="store_true")
    ap.add_argument("--tail", type=int, default=10)
    ap.add_argument("-k", type=int, default=None)
    a = ap.parse_args(argv)
    known = {name for _, name in D.ENTITY_PATTERNS} | {D.ALL_BANKS}
    for name in a.entity or []:
        if name not in known:
            print(f"no class of this name, only unscoped rows will match: {name}")
    config.load()
    spark, spans = session(), []
    tracing.configure(spans.append)
    try:
        with tracing.observe(a.command, "command", spark):
            run(spark, a)
    finally:
        tracing.configure(None)
        try:
            tracing.to_table(spark, spans, f"{a.data}/spans")
        except Exception as e:  # a report of the work, not the work
            print(f"spans weren't kept: {type(e).__name__}")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    now = F.current_timestamp()
    if a.command == "harvest":
        known = _docs(spark, a.data)
        if a.resume:
            first = int(a.start) - int(a.back) + 1
            ids = store.unfetched(spark.range(first, int(a.start) + 1).toDF("rbi_id"), known.filter("rbi_id IS NOT NULL"), "rbi_id")
            got = N.fetched(ids.withColumn("source_url", F.replace(F.lit(a.url), F.lit("{id}"), F.col("rbi_id").cast("string"))), "source_url", delay=a.delay)
            pages = got.filter("content IS NOT NULL").select("rbi_id", "source_url", N.readable("content").alias("html"))
        else:
            spark.dataSource.register(PagesById)
            pages = spark.read.format("pages_by_id").options(url=a.url, start=a.start, back=a.back, delay=str(a.delay)).load()
        delta = parse_circulars(pages, now, stop_before=a.stop_before).limit(a.limit)
        _write_swapped(store.upsert(known, delta), f"{a.data}/docs")
    elif a.command == "text":
        kept = _read_or_none(spark, f"{a.data}/bodies")
        N.bodies(_docs(spark, a.data), kept, delay=a.delay).write.mode("append").parquet(f"{a.data}/bodies")
        paths = spark.read.parquet(f"{a.data}/bodies").select("key", F.lit(f"{a.data}/bodies").alias("body_path")).distinct()
        _write_swapped(store.upsert(_docs(spark, a.data), paths), f"{a.data}/docs")
    elif a.command == "download":
        done = N.download(_docs(spark, a.data), f"{a.data}/pdfs", delay=a.delay)
        done.groupBy("outcome").count().orderBy("outcome").show()
        saved = done.filter("outcome = 'saved'").select("key", "pdf_url", "local_path")
        _write_swapped(store.upsert(_docs(spark, a.data), saved), f"{a.data}/docs")
    elif a.command == "directions":
        if a.url.startswith("http"):
            body = fetch(a.url, N.AGENT)
            if body is None:
                raise SystemExit(f"no listing behind {a.url}")
            listing = spark.createDataFrame([(body.decode("utf-8", "replace"),)], "html string")
        else:
            listing = spark.read.text(a.url, wholetext=True).withColumnRenamed("value", "html")
        _write_swapped(store.upsert(_docs(spark, a.data), parse_directions(listing, now, D.SITE + "/scripts").dropDuplicates(["key"])), f"{a.data}/docs")
    elif a.command == "organize":
        docs = _docs(spark, a.data)
        store.write_categories(docs.filter("local_path IS NOT NULL"), f"{a.data}/by_category")
        store.write_csv(docs, f"{a.data}/index")
    elif a.command == "chunk":
        made = chunks_of(spark, a.data)
        if not a.stats:
            store.write_jsonl(made, f"{a.data}/chunks")
        chunk_stats(made, "doc_key").show(truncate=False)
        class_counts(made).orderBy(F.desc("n"), "class").show(50, truncate=False)
    elif a.command == "build":
        made = chunks_of(spark, a.data)
        print(store.build_collection(made, embed(made.select("chunk_id", "text"), HashingEmbedder()), f"{a.data}/collection"), "points")
        if a.approximate:
            corpus = spark.read.parquet(f"{a.data}/collection").select(F.col("chunk_id").alias("id"), "embedding", "applies_to")
            ann.save(corpus, ann.fit(corpus), f"{a.data}/collection_lists")
    elif a.command == "models":
        G.list_models(spark, [{"name": G.ExtractiveGenerator.name}], G.ExtractiveGenerator.name, a.all).show()
    elif a.command == "history":
        log = read_log(spark, f"{a.data}/log")
        A.history(log).show(vertical=True)
        A.by_model(log).show()
        A.tail(log, a.tail).select("timestamp", "verified", "n_citations", "error", "question").show(truncate=60)
    else:
        index = spark.read.parquet(f"{a.data}/collection")
        corpus = index.select(F.col("chunk_id").alias("id"), "embedding", "applies_to")
        find = search.topk
        if a.approximate:
            lists, model = ann.load(spark, f"{a.data}/collection_lists")
            find = lambda rows, queries, k: ann.search(rows, lists, queries, model, k)
        if a.command == "probe":
            search.probe(corpus).show(60)
        elif a.command == "entity-test":
            for table in entity_test(index, entity_queries(spark, a.questions), a.k or 10, find):
                table.orderBy(F.asc_nulls_last("query_id")).show()
        elif a.command == "example":
            asked = entity_queries(spark, a.questions).orderBy("question").limit(1)
            found = find(corpus, embed_queries(asked, HashingEmbedder()).select("query_id", "embedding", F.lit(None).cast("array<string>").alias("classes")), a.k or 10)
            search.worked_example(found, asked).orderBy("rank").show(truncate=40)
        else:
            rows = spark.createDataFrame([(0, a.question, a.entity)], "query_id long, question string, entity array<string>") if a.command == "ask" else questions(spark, a.questions, a.entity)
            run_id = uuid.uuid4().hex[:8]  # shared by the questions of a run
            began = F.lit(time.time()).cast("timestamp")
            log = A.answer_batch(rows, index, HashingEmbedder(), generator(), began, run_id, a.command, a.k or 8, not a.no_filter)
            store.append_log(log, f"{a.data}/log")
            if a.command == "batch":
                store.write_jsonl(log, f"{a.data}/batch")  # the last batch, written anew by each
                A.batch_summary(log).show(vertical=True, truncate=False)
            else:
                log.show(vertical=True, truncate=False)


if __name__ == "__main__":
    main()
