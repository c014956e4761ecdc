"""Queries over what the engine reads and writes: listings, links, files, migrated tables, logs, collections and HTML tables made of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import text as X
from folioflow.operators import answer as A
from folioflow.operators import store
from folioflow.operators.blocks import blocks
from folioflow.operators.chunk import chunk, text_blocks, with_ids
from folioflow.operators.embed import HashingEmbedder, embed
from folioflow.operators.generate import decode_answers
from folioflow.operators.parse import parse_directions
from folioflow.plans.documents import _CLASS, _CLASSES, CHUNK_SQL, TITLES_SQL, _scan_sql, titles
from folioflow.plans.materialize import shared_dir, spill
from folioflow.plans.registry import Registry
from folioflow.sources import files
from folioflow.sources.tables import read_table

R = Registry()


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share; it goes when the application ends."""
    path = f"{shared_dir(spark)}/folioflow-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(found)
    return path


def _class_name():
    return F.array(*map(F.lit, _CLASSES))[(F.col("doc_id") % len(_CLASSES)).cast("int")]


def _text(column: str) -> Column:
    return F.col(column).cast("string")


_DAY = "'November ' || (doc_id % 28 + 1) || ', 2025'"


@R.add(f"""SELECT 'Master Direction ' || doc_id || ' on ' || {_CLASS} AS subject, '2025-11-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS issue_date, {_DAY} AS raw_date,
CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/md?id=' || doc_id ELSE 'https://example.org/scripts/md?id=' || doc_id END AS source_url,
{_scan_sql(f"'Master Direction ' || doc_id || ' on ' || {_CLASS}")} AS applies_to FROM documents WHERE doc_id % 3 <> 2""")
def listing_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of 50 documents each, read as master directions; other links on them are left out."""
    i = _text("doc_id")
    day = F.concat(F.lit("November "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(", 2025"))
    href = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.org/md?id="), i)).otherwise(F.concat(F.lit("/md?id="), i))
    name = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("Another long link text "), i)).otherwise(F.concat(F.lit("Master Direction "), i, F.lit(" on "), _class_name()))
    item = F.concat(F.lit('<li><a href="'), href, F.lit('">'), name, F.lit("</a> <span>"), day, F.lit("</span></li>"))
    pages = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("page"), item.alias("item")).groupBy("page").agg(F.collect_list("item").alias("items"))
    html = F.concat(F.lit('<a href="/">x</a><ul>'), F.array_join("items", ""), F.lit("</ul>"))
    found = parse_directions(pages.select(html.alias("html")), F.lit("2026-01-01").cast("timestamp"), "https://example.org/scripts")
    return found.select("subject", "issue_date", "raw_date", "source_url", "applies_to")


@R.add("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://rbidocs.rbi.org.in/rdocs/Notification/PDFs/' || doc_id || '.pdf' WHEN 1 THEN 'https://www.rbi.org.in/a/' || doc_id || '.PDF'
WHEN 2 THEN 'http://rbidocs.rbi.org.in/x?id=' || doc_id END AS link FROM documents""")
def document_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document among the links of a page."""
    i, n = F.col("doc_id"), _text("doc_id")
    chrome, other = F.lit("/rdocs/content/pdfs/Utkarsh.pdf"), F.concat(F.lit("/a/"), n, F.lit(".PDF"))
    own = F.concat(F.lit("https://rbidocs.rbi.org.in/rdocs/Notification/PDFs/"), n, F.lit(".pdf"))
    links = (
        F.when(i % 5 == 0, F.array(chrome, other, own)).when(i % 5 == 1, F.array(F.lit("/index.html"), chrome, other)).when(i % 5 == 2, F.array(F.concat(F.lit("http://rbidocs.rbi.org.in/x?id="), n), other))
        .when(i % 5 == 3, F.array(chrome)).otherwise(F.array(F.lit("/a.html")))
    )
    return read_table(spark, sf_dir, "documents").select("doc_id", X.pick_link(links).alias("link"))


@R.add("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def pdf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bodies are PDFs by their first bytes."""
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 3 == 1, "<html>%PDF-").otherwise("%PDF")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(" "))).cast("binary").alias("content"))
    return docs.filter(F.coalesce(files.is_pdf(F.col("content")), F.lit(False))).select("doc_id")


_DOCS = "CASE WHEN doc_id % 4 > 0 THEN '2025-11-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as an older docs table: some columns only, and one that is no longer known."""
    day = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("2025-11-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    return read_table(spark, sf_dir, "documents").select(
        _text("doc_id").alias("key"), _text("doc_id").alias("rbi_id"), F.col("source").alias("number"), day.alias("issue_date"), F.col("lang").alias("department"),
        F.array_compact(F.array("lang", "source")).alias("applies_to"), F.when(F.col("doc_id") % 5 > 0, F.lit("bodies")).alias("body_path"), F.lit(1).alias("gone"),
    )


@R.add(f"""SELECT doc_id::VARCHAR AS key, doc_id AS rbi_id, source AS number, NULL::VARCHAR AS ref_code, {_DOCS} AS issue_date, lang AS department, list_filter([lang, source], lambda x: x IS NOT NULL) AS applies_to,
NULL::VARCHAR AS meant_for, NULL::VARCHAR AS subject, NULL::VARCHAR AS source_url, 'bodies' AS body_path FROM documents WHERE doc_id % 5 > 0""")
def docs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docs table of older columns, brought up to date, written, and scanned for documents with a body."""
    path = _folder(spark, "docs")
    schemas.migrate(_docs(spark, sf_dir), schemas.DOCS_DDL).write.parquet(path)
    return files.read_docs(spark, path)


@R.add(f"SELECT doc_id::VARCHAR AS key, coalesce(left({_DOCS}, 4), 'undated') AS year, coalesce(substring({_DOCS}, 6, 2), '00') AS month FROM documents")
def dated_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept by year and month, read back."""
    path = _folder(spark, "dated")
    store.write_dated(_docs(spark, sf_dir).select("key", "issue_date"), path)
    kept = spark.read.schema("key string, issue_date string, year string, month string").parquet(path)
    return kept.select("key", "year", "month")


@R.add(CHUNK_SQL + "SELECT 'doc:' || doc_id AS doc_key, chunk_index, section, n_chars, md5(text) AS text_md5 FROM chunks")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as lines of JSON and read by their schema."""
    path = _folder(spark, "chunks")
    store.write_jsonl(schemas.migrate(_chunks(spark, sf_dir), schemas.CHUNKS_DDL), path)
    return files.read_chunks(spark, path).select("doc_key", "chunk_index", "section", "n_chars", F.md5("text").alias("text_md5"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), _text("doc_id")).alias("doc_key"), F.array_compact(F.array("lang")).alias("applies_to"), F.col("source").alias("department"), text_blocks(F.col("text")).alias("blocks")
    )
    return with_ids(chunk(docs))


@R.add(CHUNK_SQL + "SELECT source AS department, count(*) AS points, count(DISTINCT c.doc_id) AS documents, sum(c.n_chars)::BIGINT AS chars, count(*) AS unit_vectors FROM chunks c JOIN documents d ON c.doc_id = d.doc_id GROUP BY source")
def collection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search collection built from all chunks: payload and vector of each."""
    path = _folder(spark, "collection")
    chunks = spill(schemas.migrate(_chunks(spark, sf_dir), schemas.CHUNKS_DDL), "chunks")  # read several times, made once
    store.build_collection(chunks, embed(chunks.select("chunk_id", "text"), HashingEmbedder()), path)
    length = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x * x)
    return spark.read.parquet(path).groupBy("department").agg(
        F.count("*").alias("points"), F.countDistinct("doc_key").alias("documents"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.abs(length - 1) < 1e-4).alias("unit_vectors")
    )


@R.add("""SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS model, CASE WHEN user_id % 5 = 0 THEN 'failed' END AS error, 2 AS times FROM events""")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is appended to twice keeps both runs, errors too."""
    path = _folder(spark, "log")
    e = read_table(spark, sf_dir, "events")
    for run in ("a", "b"):
        store.append_log(e.select(F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.lit(run).alias("run_id"), F.col("event_type").alias("model"), F.when(F.col("user_id") % 5 == 0, "failed").alias("error")), path)
    log = files.read_log(spark, path).select("seq", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "model", "error")
    return log.groupBy("seq", "at", "model", "error").agg(F.count("*").cast("int").alias("times"))


@R.add(f"WITH {TITLES_SQL} SELECT id, CASE WHEN len({_scan_sql('subject')}) > 0 THEN array_to_string({_scan_sql('subject')}, '; ') END AS entity FROM titles")
def detected_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that a question names; null where it names none, so that nothing is filtered."""
    return titles(spark, sf_dir).select("id", F.array_join(A.detect_entities(F.col("subject")), "; ").alias("entity"))


@R.add(r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(coalesce(text, ''), chr(8203), ''), chr(160), ' '), '[ \t]+', ' ', 'g'))) AS clean_md5 FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single spaces, without zero-width ones. The generated texts are in compatibility form."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("clean_md5"))


@R.add("""SELECT doc_id, 0 AS pos, 'text' AS kind, 'before ' || doc_id AS text FROM documents
UNION ALL SELECT doc_id, 1, 'table', '| id | source |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || doc_id || ' |  |  |' || chr(10) || '| n | ' || coalesce(lang, 'none') || ' | x ' || doc_id || ' |' FROM documents
UNION ALL SELECT doc_id, 2, 'text', 'laid out ' || doc_id FROM documents""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every document with a data table, a layout table and two tables of contents."""
    i = _text("doc_id")
    rows = F.concat(
        F.lit("<tr><th>id</th><th>source</th></tr><tr><td></td><td> </td></tr><tr><td><p>"), i, F.lit("</p></td></tr><tr><td>n<sup>1</sup></td><td>"), F.coalesce("lang", F.lit("none")),
        F.lit("</td><td>x "), i, F.lit("</td></tr>"),
    )
    links = "".join(f"<tr><td><a href='#{n}'>part {n}</a></td></tr>" for n in range(9)) + "<tr><td>end</td></tr>"
    html = F.concat(
        F.lit('<table class="td"><tr><td><p>before '), i, F.lit("</p><table>"), rows, F.lit("</table><table><tr><td><p>laid out "), i, F.lit("</p></td></tr></table><table><tr><td>Table of Contents</td><td>1</td></tr></table><table>" + links + "</table></td></tr></table>"),
    )
    made = read_table(spark, sf_dir, "documents").select("doc_id", html.alias("html")).select("doc_id", blocks("html").alias("b"))
    return made.select("doc_id", F.posexplode("b").alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.text")


@R.add("SELECT doc_id::VARCHAR AS key, 'bodies/' || doc_id AS body_path, length(text) AS n_chars FROM documents WHERE doc_id % 5 > 0 AND doc_id % 3 > 0")
def docs_with_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside their bodies; those without a path, and those whose file is missing, are left out."""
    docs = _docs(spark, sf_dir).withColumn("body_path", F.when(F.col("body_path").isNotNull(), F.concat(F.lit("bodies/"), F.col("key"))))
    kept = read_table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select(F.concat(F.lit("bodies/"), _text("doc_id")).alias("body_path"), F.col("text").alias("html"))
    return files.with_bodies(docs, kept).select("key", "body_path", F.char_length("html").cast("long").alias("n_chars"))


@R.add("""SELECT conv_id, turn, md5(text) AS answer_md5, turn % 3 AS source_id, left(text, 20) AS quote, turn % 2 = 0 AS insufficient_context FROM conversations WHERE text IS NOT NULL""")
def answers_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in the conversations as answers in JSON, decoded by their schema."""
    cites = F.array(F.struct((F.col("turn") % 3).alias("source_id"), F.substring("text", 1, 20).alias("quote")))
    body = F.to_json(F.struct(F.col("text").alias("answer"), cites.alias("citations"), (F.col("turn") % 2 == 0).alias("insufficient_context"), F.lit("more").alias("unknown")))
    said = read_table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", body.alias("json"))
    reply, cite = F.col("reply"), F.col("reply.citations")[0]
    return decode_answers(said).select(
        "conv_id", "turn", F.md5(reply["answer"]).alias("answer_md5"), cite["source_id"].cast("long").alias("source_id"), cite["quote"].alias("quote"), reply["insufficient_context"].alias("insufficient_context")
    )
