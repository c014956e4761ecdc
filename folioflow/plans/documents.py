"""Parsing, chunking, citation and answering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import dictionaries as D
from folioflow.functions import tables
from folioflow.functions import text as X
from folioflow.operators import answer as A
from folioflow.operators import store
from folioflow.operators.blocks import blocks, page_parts
from folioflow.operators.chunk import chunk, chunk_stats, class_counts, split_table, text_blocks, with_ids
from folioflow.operators.containment import containment
from folioflow.operators.dictionary import named
from folioflow.operators.embed import HashingEmbedder, embed
from folioflow.operators.generate import ExtractiveGenerator, format_sources
from folioflow.operators.parse import parse_circulars
from folioflow.operators.verify import verified, verify
from folioflow.plans.materialize import spill
from folioflow.plans.registry import Registry
from folioflow.sources.tables import read_table

R = Registry()


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_CLASSES = [name for _, name in D.ENTITY_PATTERNS]
_CLASS = f"list_extract([{', '.join(_q(c) for c in _CLASSES)}], (doc_id % {len(_CLASSES)} + 1)::INT)"
# titles and addressees of the documents in the forms that circulars have
TITLES_SQL = f"""titles AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Reserve Bank of India (' || {_CLASS} || ' – Conduct) Directions, 2025' WHEN 1 THEN 'Notes to ' || lower({_CLASS}) || ' on ' || coalesce(source, '')
  WHEN 2 THEN left(text, 60) END AS subject, CASE doc_id % 3 WHEN 0 THEN 'All banks,' WHEN 1 THEN 'All ' || {_CLASS} END AS meant_for FROM documents)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, meant_for) of every document."""
    i = F.col("doc_id")
    name = F.array(*map(F.lit, _CLASSES))[(i % len(_CLASSES)).cast("int")]
    subject = (
        F.when(i % 4 == 0, F.concat(F.lit("Reserve Bank of India ("), name, F.lit(" – Conduct) Directions, 2025")))
        .when(i % 4 == 1, F.concat(F.lit("Notes to "), F.lower(name), F.lit(" on "), F.coalesce("source", F.lit("")))).when(i % 4 == 2, F.substring("text", 1, 60))
    )
    meant_for = F.when(i % 3 == 0, "All banks,").when(i % 3 == 1, F.concat(F.lit("All "), name))
    return read_table(spark, sf_dir, "documents").select(i.alias("id"), subject.alias("subject"), meant_for.alias("meant_for"))


def _scan_sql(text: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches(coalesce({text}, ''), {_q('(?i)' + p)}) THEN {_q(n)} END" for p, n in D.ENTITY_PATTERNS)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


_FOUND = f"SELECT id, {_scan_sql('coalesce(subject, chr(32)) || chr(32) || coalesce(meant_for, chr(32))')} AS found FROM titles"


@R.add(f"WITH {TITLES_SQL} {_FOUND}")
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = titles(spark, sf_dir)
    return df.select("id", X.scan_entities(F.concat_ws(" ", F.coalesce("subject", F.lit(" ")), F.coalesce("meant_for", F.lit(" ")))).alias("found"))


@R.add(f"WITH {TITLES_SQL} SELECT entity, count(*) AS n FROM (SELECT unnest(found) AS entity FROM ({_FOUND})) GROUP BY entity")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_scan(spark, sf_dir).select(F.explode("found").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


_HEAD = f"""string_split(regexp_replace(regexp_extract(coalesce(subject, ''), {_q('(?i)' + D.TITLE_PATTERN)}, 1), {_q(D.TOPIC_PATTERN)}, chr(1)), chr(1))[1]"""


_BINDS = f"""h AS (SELECT *, {_HEAD} AS head FROM titles), f AS (SELECT *, {_scan_sql('head')} AS a, {_scan_sql('meant_for')} AS b FROM h),
g AS (SELECT *, a || list_filter(b, lambda x: NOT list_contains(a, x)) AS found FROM f),
binds AS (SELECT id, subject, meant_for, CASE WHEN len(found) = 0 AND regexp_matches(coalesce(meant_for, ''), {_q('(?i)' + D.ALL_BANKS_PATTERN)}) THEN [{_q(D.ALL_BANKS)}] ELSE found END AS applies_to FROM g)"""


@R.add(f"WITH {TITLES_SQL}, {_BINDS} SELECT id, applies_to FROM binds")
def applies_to_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", X.applies_to(F.col("subject"), F.col("meant_for")).alias("applies_to"))


_REFS = """refs AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'RBI/' || coalesce(lang, 'DoS') || '/2025-26/' || doc_id WHEN 1 THEN 'RBI/2025-26/' || doc_id END AS number,
  CASE doc_id % 5 WHEN 0 THEN 'CO.' || upper(coalesce(source, 'x')) || '.No.S' || doc_id WHEN 1 THEN 'A.P. (DIR Series) Circular No. ' || doc_id WHEN 2 THEN 'REF.No.MPD.BC.' || doc_id || '/07.01' WHEN 3 THEN '12/' || doc_id END AS ref FROM documents)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, number, ref): numbers and departmental references for every document in the forms that circulars have."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    number = F.when(i % 3 == 0, F.concat(F.lit("RBI/"), F.coalesce("lang", F.lit("DoS")), F.lit("/2025-26/"), n)).when(i % 3 == 1, F.concat(F.lit("RBI/2025-26/"), n))
    ref = (
        F.when(i % 5 == 0, F.concat(F.lit("CO."), F.upper(F.coalesce("source", F.lit("x"))), F.lit(".No.S"), n)).when(i % 5 == 1, F.concat(F.lit("A.P. (DIR Series) Circular No. "), n))
        .when(i % 5 == 2, F.concat(F.lit("REF.No.MPD.BC."), n, F.lit("/07.01"))).when(i % 5 == 3, F.concat(F.lit("12/"), n))
    )
    return read_table(spark, sf_dir, "documents").select(i.alias("id"), number.alias("number"), ref.alias("ref"))


@R.add(f"""WITH {_REFS}, t AS (SELECT *, list_filter(list_transform(regexp_extract_all(coalesce(ref, ''), '[A-Za-z]+'), lambda x: upper(x)), lambda x: length(x) > 1 AND x NOT IN ('CO', 'RBI', 'NO', 'REF')) AS k FROM refs)
SELECT id, CASE WHEN regexp_extract(coalesce(number, ''), '^RBI/([A-Za-z]+)/', 1) <> '' THEN upper(regexp_extract(number, '^RBI/([A-Za-z]+)/', 1))
WHEN regexp_matches(trim(coalesce(ref, '')), '(?i)^A\\.\\s*P\\.') THEN 'AP-DIR' ELSE k[1] END AS department FROM t""")
def department_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).select("id", X.department(F.col("number"), F.col("ref")).alias("department"))


@R.add(f"WITH {_REFS} SELECT id, nullif(regexp_extract('see ' || number || ' of ' || coalesce(ref, 'x'), {_q(D.NUMBER_PATTERN)}, 0), '') AS number FROM refs")
def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), F.col("number"), F.lit(" of "), F.coalesce("ref", F.lit("x")))
    return refs(spark, sf_dir).select("id", X.number_of(text).alias("number"))


@R.add(f"""WITH d AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'Mumbai, ' || strftime(ts, '%B %-d, %Y') WHEN 1 THEN 'dated ' || strftime(ts, '%-d.%-m.%Y') WHEN 2 THEN strftime(ts, '%b %d,%Y')
  WHEN 3 THEN 'Foo 6, 2026 and ' || strftime(ts, '%d.%m.%Y') WHEN 4 THEN strftime(ts, '%d') || '.31.2026' ELSE 'no date' END AS t FROM events),
m AS (SELECT id, t, regexp_extract(t, {_q(D.LONG_DATE_PATTERN)}, 0) AS a, regexp_extract(t, {_q(D.DOT_DATE_PATTERN)}, 0) AS b,
concat_ws(' ', regexp_extract(t, {_q(D.LONG_DATE_PATTERN)}, 1), regexp_extract(t, {_q(D.LONG_DATE_PATTERN)}, 2), regexp_extract(t, {_q(D.LONG_DATE_PATTERN)}, 3)) AS l FROM d)
SELECT id, CASE WHEN a <> '' THEN strftime(coalesce(try_strptime(l, '%B %d %Y'), try_strptime(l, '%b %d %Y')), '%Y-%m-%d') WHEN b <> '' THEN strftime(try_strptime(b, '%d.%m.%Y'), '%Y-%m-%d') END AS issue_date,
nullif(CASE WHEN a <> '' THEN a ELSE b END, '') AS raw_date FROM m""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all events, written in the forms that circulars have, and read again."""
    i, day = F.col("event_id"), lambda form: F.date_format("ts", form)
    text = (
        F.when(i % 6 == 0, F.concat(F.lit("Mumbai, "), day("MMMM d, yyyy"))).when(i % 6 == 1, F.concat(F.lit("dated "), day("d.M.yyyy"))).when(i % 6 == 2, day("MMM dd,yyyy"))
        .when(i % 6 == 3, F.concat(F.lit("Foo 6, 2026 and "), day("dd.MM.yyyy"))).when(i % 6 == 4, F.concat(day("dd"), F.lit(".31.2026"))).otherwise("no date")
    )
    df = read_table(spark, sf_dir, "events").select(i.alias("id"), text.alias("text"))
    return df.select("id", X.iso_date(F.col("text")).alias("issue_date"), X.raw_date(F.col("text")).alias("raw_date"))


@R.add("SELECT page_id, trim(left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 120), '_') AS name FROM pages")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@R.add("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '[?]page=') AS paged, starts_with(url, 'https') AS secure FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), url.rlike("[?]page=").alias("paged"), F.startswith(url, F.lit("https")).alias("secure"))


@R.add("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages")
def page_title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


# the generated pages have no tables and open a paragraph only by <p>; it ends at its end tag, at the next one, or with the article
_PAGE_BLOCKS = r"""WITH parts AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>|<!--.*?-->', '', 'g'), '</p>|</article>', chr(1), 'g'), '<p>')[2:]) AS part,
  generate_subscripts(string_split(regexp_replace(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>|<!--.*?-->', '', 'g'), '</p>|</article>', chr(1), 'g'), '<p>')[2:], 1) AS place FROM pages),
bare AS (SELECT page_id, place, regexp_replace(replace(replace(replace(replace(regexp_replace(string_split(part, chr(1))[1], '\s*<[^>]*>\s*', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM parts),
texts AS (SELECT page_id, place, trim(regexp_replace(t, '[ \t]+', ' ', 'g')) AS text FROM bare)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS pos, 'text' AS kind, text FROM texts WHERE text <> ''"""


@R.add(_PAGE_BLOCKS)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_table(spark, sf_dir, "pages").select("page_id", blocks("html").alias("b"))
    return made.select("page_id", F.posexplode("b").alias("pos", "b")).select("page_id", "pos", "b.kind", "b.text")


@R.add(r"""WITH plain AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style).*?</(script|style)>|<!--.*?-->', '', 'g') AS html FROM pages),
links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS n FROM plain)
SELECT page_id, n::INT - 1 AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS text FROM links""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, in order, as the parser reads it: what the choice of a document is made of."""
    parts = read_table(spark, sf_dir, "pages").select("page_id", page_parts("html").alias("p"))
    return parts.select("page_id", F.posexplode("p.anchors").alias("pos", "a")).select("page_id", "pos", "a.href", "a.text")


@R.add(_PAGE_BLOCKS)
def page_blocks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks by a table function in SQL: its columns follow those of the table it is given."""
    tables.register(spark)
    read_table(spark, sf_dir, "pages").select("page_id", "html").createOrReplaceTempView("folioflow_pages")
    return spark.sql("SELECT * FROM page_blocks(TABLE(folioflow_pages) PARTITION BY page_id)")


@R.add(f"""WITH {TITLES_SQL.replace("CASE doc_id % 4 WHEN 0 THEN", "CASE WHEN true THEN").replace(" WHEN 1 THEN 'Notes", " WHEN false THEN 'Notes").replace("  WHEN 2 THEN left", "  WHEN false THEN left")}, {_BINDS}
SELECT 'circular:' || id AS key, 'RBI/2025-26/' || id AS number, '2025-11-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') AS issue_date, 'AP-DIR' AS department, meant_for, applies_to, subject,
CASE id % 3 WHEN 0 THEN 'https://rbidocs.rbi.org.in/rdocs/Notification/PDFs/N' || id || '.PDF' WHEN 1 THEN 'https://www.rbi.org.in/x/N' || id || '.pdf' END AS pdf_url FROM binds""")
def circular_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circular made of every document's title, parsed: number, reference, date, addressee, subject, classes and link."""
    i = F.col("id").cast("string")
    name = F.array(*map(F.lit, _CLASSES))[(F.col("id") % len(_CLASSES)).cast("int")]
    subject = F.concat(F.lit("Reserve Bank of India ("), name, F.lit(" – Conduct) Directions, 2025"))
    p = lambda *parts: F.concat(F.lit("<p>"), *parts, F.lit("</p>"))
    link = F.when(F.col("id") % 3 == 0, F.concat(F.lit('<a href="/y/other.pdf">o</a><a href="https://rbidocs.rbi.org.in/rdocs/Notification/PDFs/N'), i, F.lit('.PDF">n</a>'))).when(
        F.col("id") % 3 == 1, F.concat(F.lit('<a href="/rdocs/content/pdfs/Utkarsh.pdf">u</a><a href="/x/N'), i, F.lit('.pdf">x</a>'))
    ).otherwise('<a href="/rdocs/content/pdfs/Accessibility.pdf">a</a>')
    html = F.concat(
        F.lit('<table class="td"><tr><td>'), p(F.lit("RBI/2025-26/"), i, F.lit("<br/>A.P. (DIR Series) Circular No. "), i), p(F.lit("November "), (F.col("id") % 28 + 1).cast("string"), F.lit(", 2025")),
        F.when(F.col("meant_for").isNotNull(), p(F.col("meant_for"))).otherwise(""), p(F.lit("Madam / Sir,")), p(subject), p(F.lit("The bank shall keep records. ")), F.lit("</td></tr></table>"), link,
    )
    pages = titles(spark, sf_dir).select(F.col("id").alias("rbi_id"), html.alias("html"))
    none = spark.createDataFrame([(-1, "<p>no number</p>")], "rbi_id long, html string")
    return parse_circulars(pages.unionByName(none), F.lit("2026-01-01").cast("timestamp")).select("key", "number", "issue_date", "department", "meant_for", "applies_to", "subject", "pdf_url")


_SENTENCES = r"string_split(regexp_replace({}, '([.;])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@R.add(f"SELECT doc_id, len({_SENTENCES.format('text')})::INT AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


_LINE_ROWS = """lines AS (SELECT doc_id, '| ' || trim(line) || ' |' AS r, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> '')"""
_TABLE_HEAD = "| Line |\n| --- |\n"


_TABLE_PARTS = f"""WITH RECURSIVE {_LINE_ROWS},
fold AS (SELECT doc_id, place, r, 0 AS part, length(r) + 1 AS n FROM lines WHERE place = 1
  UNION ALL SELECT s.doc_id, s.place, s.r, CASE WHEN full_up THEN part + 1 ELSE part END, CASE WHEN full_up THEN 0 ELSE n END + length(s.r) + 1
  FROM (SELECT t.doc_id, t.place, t.r, f.part, f.n, f.n + length(t.r) > {D.MAX_CHARS - 2 - len("| Line |") - len("| --- |")} AS full_up FROM fold f JOIN lines t ON t.doc_id = f.doc_id AND t.place = f.place + 1) s),
whole AS (SELECT doc_id, '| Line |' || chr(10) || '| --- |' || chr(10) || string_agg(r, chr(10) ORDER BY place) AS md FROM lines GROUP BY doc_id),
parts AS (SELECT doc_id, part, '| Line |' || chr(10) || '| --- |' || chr(10) || string_agg(r, chr(10) ORDER BY place) AS text FROM fold GROUP BY doc_id, part),
split AS (SELECT p.doc_id, p.part, CASE WHEN length(md) <= {D.MAX_CHARS} THEN md ELSE p.text END AS text FROM parts p JOIN whole USING (doc_id) WHERE length(md) > {D.MAX_CHARS} OR part = 0)
"""


def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md): the lines of every document as a markdown table."""
    lines = F.transform(text_blocks(F.col("text")), lambda b: F.concat(F.lit("| "), b["text"], F.lit(" |")))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    return docs.select("doc_id", F.concat(F.lit(_TABLE_HEAD), F.array_join("lines", "\n")).alias("md"))


@R.add(_TABLE_PARTS + "SELECT doc_id, part::INT AS part, md5(text) AS text_md5 FROM split")
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in parts that repeat its head."""
    return line_tables(spark, sf_dir).select("doc_id", F.posexplode(split_table(F.col("md"))).alias("part", "text")).select("doc_id", "part", F.md5("text").alias("text_md5"))


@R.add(_TABLE_PARTS + f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chunk_index, 'Annex' AS section, length(text)::INT AS n_chars, md5(text) AS text_md5
FROM split WHERE length(text) >= {D.MIN_CHARS}""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under a heading, with a short line before them: each part of a table is a chunk of its own."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    docs = line_tables(spark, sf_dir).select("doc_id", F.array(block("text", F.lit("Annex")), block("text", F.lit("A short line.")), block("table", F.col("md"))).alias("blocks"))
    return chunk(docs).select("doc_id", "chunk_index", "section", "n_chars", F.md5("text").alias("text_md5"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_blocks(F.col("text")).alias("blocks"))
    return chunk(docs)


_LEVEL = " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN {n}" for n, p in D.HEADING_PATTERNS)
CHUNK_SQL = rf"""
WITH RECURSIVE lines AS (
  SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
  WHERE trim(line) <> ''),
levels AS (SELECT *, CASE WHEN length(line) > 120 THEN NULL {_LEVEL} END AS level FROM lines),
parts AS (
  SELECT doc_id, pos, 0 AS sub, 'head' AS op, line AS t, level FROM levels WHERE level IS NOT NULL
  UNION ALL SELECT doc_id, pos, 0, CASE WHEN length(line) > 1800 THEN 'cut' ELSE 'add' END, line, NULL FROM levels WHERE level IS NULL
  UNION ALL SELECT doc_id, pos, sub, 'add', t, NULL FROM (
    SELECT doc_id, pos, unnest({_SENTENCES.format('line')}) AS t, generate_subscripts({_SENTENCES.format('line')}, 1) AS sub FROM levels WHERE level IS NULL AND length(line) > 1800)),
steps AS (SELECT doc_id, op, t, level, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS idx FROM parts),
fold AS (
  SELECT doc_id, 0::BIGINT AS idx, '' AS buf, 0::BIGINT AS n, []::VARCHAR[] AS path, NULL::VARCHAR AS emitted, []::VARCHAR[] AS spot FROM documents
  UNION ALL
  SELECT doc_id, idx, CASE WHEN op <> 'add' THEN carried WHEN counted > 0 THEN carried || chr(10) || t ELSE t END, CASE WHEN op = 'add' THEN counted + length(t) + 1 ELSE counted END,
         CASE WHEN op = 'head' THEN path[1:level] || [t] ELSE path END, CASE WHEN flush AND length(text) >= 80 THEN text END, path
  FROM (SELECT *, CASE WHEN NOT flush THEN buf WHEN op = 'head' OR tail IS NULL THEN '' ELSE tail END AS carried,
               CASE WHEN NOT flush THEN n WHEN op = 'head' OR tail IS NULL THEN 0 ELSE length(tail) END AS counted
        FROM (SELECT s.doc_id, s.idx, s.op, s.t, s.level, f.buf, f.n, f.path, regexp_replace(f.buf, '^\s+|\s+$', '', 'g') AS text,
                     s.op <> 'add' OR (f.n > 0 AND f.n + length(s.t) > 1100) AS flush,
                     CASE WHEN length(regexp_replace(f.buf, '^\s+|\s+$', '', 'g')) > 150
                          THEN substring(right(regexp_replace(f.buf, '^\s+|\s+$', '', 'g'), 150), instr(right(regexp_replace(f.buf, '^\s+|\s+$', '', 'g'), 150), ' ') + 1) END AS tail
              FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.idx = f.idx + 1))),
ends AS (SELECT doc_id, idx + 1 AS idx, regexp_replace(buf, '^\s+|\s+$', '', 'g') AS emitted, path AS spot FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) = 1),
made AS (SELECT doc_id, idx, emitted, spot FROM fold WHERE emitted IS NOT NULL UNION ALL SELECT doc_id, idx, emitted, spot FROM ends WHERE length(emitted) >= 80),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS chunk_index, CASE WHEN len(spot) > 0 THEN array_to_string(spot, ' > ') END AS section, emitted AS text, length(emitted)::INT AS n_chars FROM made)
"""


@R.add(CHUNK_SQL + "SELECT doc_id, pos::INT AS position, level FROM levels")
def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading level of every line with text in the documents, null for what is no heading; positions count all lines from 1."""
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    lines = lines.select("doc_id", (F.col("at") + 1).alias("position"), F.trim("line").alias("line")).filter("line <> ''")
    return lines.select("doc_id", "position", X.heading_level(F.col("line")).alias("level"))


@R.add(CHUNK_SQL + "SELECT doc_id, chunk_index, section, n_chars, md5(text) AS text_md5 FROM chunks")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select("doc_id", "chunk_index", "section", "n_chars", F.md5("text").alias("text_md5"))


@R.add(CHUNK_SQL + """, per AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT (SELECT count(*) FROM per) AS documents, count(*) AS chunks, (SELECT min(n) FROM per) AS min_chunks, (SELECT max(n) FROM per) AS max_chunks, min(n_chars) AS min_chars,
(sum(n_chars) // count(*))::BIGINT AS mean_chars, max(n_chars) AS max_chars, count(section) AS with_section, count(*) FILTER (starts_with(text, '|')) AS tables,
(100 * count(section) // greatest(count(*), 1))::BIGINT AS section_percent, (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] FROM per) AS median_chunks FROM chunks""")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = chunk_stats(document_chunks(spark, sf_dir), "doc_id")
    return stats.select(*[F.col(c).cast("long").alias(c) if c not in ("min_chars", "max_chars") else F.col(c) for c in stats.columns])


@R.add("WITH s AS (SELECT CASE WHEN lang IS NULL THEN [] ELSE [lang, source] END AS a FROM documents) SELECT class, count(*) AS n FROM (SELECT unnest(CASE WHEN len(a) = 0 THEN ['(unscoped)'] ELSE a END) AS class FROM s) WHERE class IS NOT NULL GROUP BY class")
def class_counts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.when(F.col("lang").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array("lang", "source"))).alias("applies_to"))
    return class_counts(docs)


_NORM = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"


@R.add(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(X.norm(F.col("text"))).alias("norm_md5"))


@R.add(f"SELECT sha256({_NORM.format('text')}) AS family, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.sha2(X.norm(F.col("text")), 256).alias("family")
    return read_table(spark, sf_dir, "documents").groupBy(family).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@R.add(f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON {_NORM.format('b.text')} <> '' AND contains({_NORM.format('d.text')}, {_NORM.format('b.text')})")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return containment(docs, items, "doc_id", "item_id")


_QUOTES = """quotes AS (SELECT conv_id || ':' || turn || ':' || part AS quote_id, CASE part WHEN 0 THEN left(text, 12) WHEN 1 THEN substr(text, 9, 70) ELSE right(text, 9) END AS text
  FROM conversations, (SELECT unnest([0, 1, 2]) AS part) WHERE text IS NOT NULL)"""


@R.add(f"""WITH {_QUOTES}, plain AS (SELECT conv_id, {_NORM.format('text')} AS t FROM conversations),
asked AS (SELECT quote_id, {_NORM.format('text')} AS q FROM quotes), needed AS (SELECT DISTINCT q FROM asked WHERE q <> ''),
met AS (SELECT q, count(DISTINCT conv_id) AS n FROM needed JOIN plain ON contains(t, q) GROUP BY q)
SELECT quote_id, coalesce(n, 0) AS n_conversations FROM asked LEFT JOIN met USING (q)""")
def quote_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quotes of every turn, short and long ones: in how many conversations their words stand."""
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    part = F.explode(F.array(*map(F.lit, range(3)))).alias("part")
    quote = F.when(F.col("part") == 0, F.substring("text", 1, 12)).when(F.col("part") == 1, F.substring("text", 9, 70)).otherwise(F.substring("text", -9, 9))
    quotes = talks.filter("text IS NOT NULL").select("*", part).select(F.concat_ws(":", "conv_id", "turn", "part").alias("quote_id"), quote.alias("text"))
    hits = containment(talks.select("conv_id", "text"), quotes, "conv_id", "quote_id").groupBy("quote_id").agg(F.count("*").alias("n"))
    return quotes.select("quote_id").join(hits, "quote_id", "left").select("quote_id", F.coalesce("n", F.lit(0)).alias("n_conversations"))


#: A dictionary made of the tables: every word of seven ASCII letters and more of turns and benchmark items, with and without an ending.
_TERMS = r"""said AS (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark),
terms AS (SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D.,]+')) AS w FROM said) WHERE regexp_full_match(w, '[a-z]{7,}'))"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, pattern) of the dictionary."""
    said = read_table(spark, sf_dir, "conversations").select("text").unionByName(read_table(spark, sf_dir, "benchmark").select("text"))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D.,]+"), F.lit(0)))
    found = said.select(word.alias("term_id")).filter(F.col("term_id").rlike("^[a-z]{7,}$")).distinct()
    return found.select("term_id", F.concat(F.lit(r"\b"), "term_id", F.lit(r"(?:s|en)?\b")).alias("pattern"))


@R.add(rf"""WITH {_TERMS},
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
forms AS (SELECT term, term AS w FROM terms UNION ALL SELECT term, term || 's' FROM terms UNION ALL SELECT term, term || 'en' FROM terms)
SELECT term, count(DISTINCT doc_id) AS n_docs FROM forms JOIN words USING (w) GROUP BY term""")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term of a large dictionary of patterns stands."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return named(docs, terms(spark, sf_dir)).groupBy(F.col("term_id").alias("term")).agg(F.count("*").alias("n_docs"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers to check: their turns are the sources, five quotes cite them."""
    turn = F.struct("turn", "text")
    talk = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    texts = F.transform("turns", lambda t: F.coalesce(t["text"], F.lit("")))
    first, last = F.replace(F.substring(texts[0], 5, 30), F.lit(" "), F.lit("  ")), F.substring(F.element_at(texts, -1), 5, 40)
    cite = lambda n, q: F.struct(F.lit(n).alias("source_id"), q.alias("quote"))
    cited = F.array(cite(1, first), cite(1, last), cite(99, first), cite(1, F.lit("never said by anyone")), cite(0, F.lit("")))
    return talk.select("conv_id", texts.alias("texts"), F.transform("turns", lambda t: F.concat(F.lit("turn "), t["turn"].cast("string"))).alias("numbers"), cited.alias("citations"))


CITATION_SQL = f"""
WITH talk AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS texts, list('turn ' || turn ORDER BY turn) AS numbers FROM conversations GROUP BY conv_id),
cites AS (SELECT conv_id, texts, numbers, unnest([1, 2, 3, 4, 5]) AS place, unnest([1, 1, 99, 1, 0]) AS source_id,
  unnest([replace(substring(texts[1], 5, 30), ' ', '  '), substring(texts[-1], 5, 40), replace(substring(texts[1], 5, 30), ' ', '  '), 'never said by anyone', '']) AS quote FROM talk),
found AS (SELECT *, list_filter(range(1, len(texts) + 1), lambda i: {_NORM.format('quote')} <> '' AND contains({_NORM.format('texts[i]')}, {_NORM.format('quote')})) AS found_in FROM cites),
checks AS (SELECT conv_id, place, source_id, CASE WHEN list_contains(found_in, source_id) THEN 'ok' WHEN len(found_in) > 0 THEN 'wrong_source' ELSE 'not_found' END AS status, len(found_in)::INT AS n_found,
  CASE WHEN source_id BETWEEN 1 AND len(texts) THEN numbers[source_id] END AS cited_doc FROM found)
"""


@R.add(CITATION_SQL + "SELECT conv_id, (place - 1)::INT AS place, source_id, status, n_found, cited_doc FROM checks")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _talks(spark, sf_dir).select("conv_id", F.posexplode(verify(F.col("citations"), F.col("texts"), F.col("numbers"))).alias("place", "c"))
    return checks.select("conv_id", "place", "c.source_id", "c.status", F.size("c.found_in").alias("n_found"), "c.cited_doc")


@R.add(CITATION_SQL + "SELECT status, count(*) AS n FROM checks GROUP BY status")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_verify(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@R.add(CITATION_SQL + "SELECT conv_id, count(*) FILTER (status = 'ok')::INT AS verified FROM checks GROUP BY conv_id")
def answer_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", verified(verify(F.col("citations"), F.col("texts"), F.col("numbers"))).alias("verified"))


@R.add("SELECT doc_id::VARCHAR AS number, left(source, 10) AS issue_date, lang AS department, concat_ws('; ', lang, source) AS applies_to, NULL::VARCHAR AS meant_for, source AS subject, NULL::VARCHAR AS path FROM documents")
def csv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    shaped = docs.select(
        F.col("doc_id").cast("string").alias("number"), F.substring("source", 1, 10).alias("issue_date"), F.col("lang").alias("department"), F.array_compact(F.array("lang", "source")).alias("applies_to"),
        none.alias("meant_for"), F.col("source").alias("subject"), none.alias("local_path"),
    )
    return store.csv_index(shaped)


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents as a search index: the language is the class a chunk binds."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("doc_key"), F.col("doc_id").cast("string").alias("number"), F.lit(None).cast("string").alias("issue_date"),
        F.array_compact(F.array("lang")).alias("applies_to"), F.col("source").alias("subject"), text_blocks(F.col("text")).alias("blocks"),
    )
    return embed(with_ids(chunk(docs)), HashingEmbedder())


def _answers(spark: SparkSession, sf_dir: str, due: str, source: str) -> DataFrame:
    """Answers to what users say in the conversations that ``due`` names, from all documents."""
    turns = read_table(spark, sf_dir, "conversations").filter(f"role = 'user' AND text IS NOT NULL AND {due}")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    index = spill(document_index(spark, sf_dir), "index")  # searched, then read for the texts of the hits
    return A.answer_batch(asked, index, HashingEmbedder(), ExtractiveGenerator(), F.lit("2026-01-01").cast("timestamp"), "run", source)


@R.add()
def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, "conv_id = 0 AND turn = 0", "ask").drop("seconds")


@R.add()
def batch_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that users ask in any conversation, answered and summed up."""
    return A.batch_summary(_answers(spark, sf_dir, "true", "batch")).drop("median_seconds")


@R.add(CITATION_SQL + """, log AS (SELECT conv_id, conv_id % 7 = 3 AS failed, conv_id % 5 = 1 AS short, (conv_id * 31 % 101) / 4.0 AS seconds FROM talk)
SELECT count(*) FILTER (NOT failed) AS answered, count(*) FILTER (NOT failed AND short) AS insufficient, (SELECT count(*) FROM checks WHERE status = 'ok' AND conv_id % 7 <> 3) AS ok,
(SELECT count(*) FROM checks WHERE status = 'wrong_source' AND conv_id % 7 <> 3) AS wrong_source, (SELECT count(*) FROM checks WHERE status = 'not_found' AND conv_id % 7 <> 3) AS not_found, count(*) AS asked,
list_sort(list(seconds) FILTER (NOT failed))[count(*) FILTER (NOT failed) // 2 + 1]::DOUBLE AS median_seconds FROM log""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a batch whose answers are the conversations."""
    i = F.col("conv_id")
    log = _talks(spark, sf_dir).select(
        verify(F.col("citations"), F.col("texts"), F.col("numbers")).alias("citations"), F.when(i % 7 == 3, "failed").alias("error"), (i % 5 == 1).alias("insufficient_context"), ((i * 31 % 101) / 4.0).alias("seconds")
    )
    return A.batch_summary(log)


@R.add("SELECT doc_id, '[1] ' || doc_id || '  (None)' || chr(10) || 'binds: ' || coalesce(lang, '(not entity-scoped)') || chr(10) || 'document: ' || coalesce(source, 'None') || chr(10) || 'section: -' || chr(10) || '---' || chr(10) || coalesce(lang, 'x') AS block FROM documents")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    one = F.struct(
        F.col("doc_id").cast("string").alias("number"), F.lit(None).cast("string").alias("issue_date"), F.array_compact(F.array("lang")).alias("applies_to"), F.col("source").alias("subject"),
        F.lit(None).cast("string").alias("section"), F.coalesce("lang", F.lit("x")).alias("text"),
    )
    return d.select("doc_id", format_sources(F.array(one)).alias("block"))
