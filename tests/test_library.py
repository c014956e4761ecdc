"""Parsing, chunking, search, storage and answering on small hand-made inputs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow import config, schemas, tracing
from folioflow import dictionaries as D
from folioflow.functions import text as X
from folioflow.operators import answer as A
from folioflow.operators import search, store
from folioflow.operators.blocks import blocks_of, body_html, page_parts
from folioflow.operators.chunk import chunk, chunk_stats, split_table, with_ids
from folioflow.operators.embed import HashingEmbedder, embed
from folioflow.operators.generate import ExtractiveGenerator, QuotaExhausted, Transient, decode_answers, list_models, with_retry
from folioflow.operators.parse import parse_circulars, parse_directions
from folioflow.operators.verify import verify

def NOW():  # noqa: N802
    return F.lit("2026-01-01").cast("timestamp")



def page(*paragraphs, after=""):
    return '<table class="td"><tr><td>' + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</td></tr></table>{after}"


def parsed(spark, html):
    return parse_circulars(spark.createDataFrame([(7, html)], "rbi_id long, html string"), NOW()).collect()


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)])
    return df.select(column.alias("x")).first()["x"]


def test_circular_with_addressee_and_link(spark):
    html = page("RBI/2025-26/205<br>A.P. (DIR Series) Circular No. 22", "February 6, 2026", "To", "All Authorised Dealer Category-I banks", "Madam / Sir,", "Voluntary Retention Route – changes", after='<a href="/x/Utkarsh.pdf">u</a><a href="https://rbidocs.rbi.org.in/rdocs/content/pdfs/A.pdf">a</a>')
    (r,) = parsed(spark, html)
    assert (r.key, r.number, r.issue_date, r.raw_date, r.department) == ("circular:7", "RBI/2025-26/205", "2026-02-06", "February 6, 2026", "AP-DIR")
    assert r.meant_for == "All Authorised Dealer Category-I banks" and r.applies_to == ["Authorised Dealers (Category-I)"]
    assert r.subject == "Voluntary Retention Route – changes" and r.pdf_url == "https://www.rbi.org.in/x/Utkarsh.pdf"


def test_pages_without_number_or_body_are_dropped(spark):
    assert parsed(spark, page("no number here")) == [] and parsed(spark, "<p>RBI/2025-26/1</p>") == [] and parsed(spark, None) == []


def test_title_binds_its_class_and_a_missing_date_is_null(spark):
    (r,) = parsed(spark, page("RBI/DOR/2025-26/110", "Reserve Bank of India (Commercial Banks – Credit Information Reporting) Amendment Directions, 2025"))
    assert r.applies_to == ["Commercial Banks"] and r.department == "DOR" and r.issue_date is None and r.ref_code is None


def test_directions_listing(spark):
    html = '<ul><li><a href="x.aspx?id=1">Master Direction on Payments Banks</a> Aug 6, 2026</li><li><a href="y">Another long link text</a></li></ul>'
    (r,) = parse_directions(spark.createDataFrame([(html,)], "html string"), NOW(), "https://example.org/s").collect()
    assert (r.subject, r.issue_date, r.source_url, r.applies_to) == ("Master Direction on Payments Banks", "2026-08-06", "https://example.org/s/x.aspx?id=1", ["Payments Banks"])


def test_blocks_keep_order_and_look_through_layout():
    html = page("One<sup>1</sup> <b>bold</b>text", "") + "<table><tr><td><p>laid out</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table></td></tr></table>"
    assert blocks_of(html) == [("text", "One bold text")]
    wrapped = f'<table class="td"><tr><td>{html}</td></tr></table>'
    assert blocks_of(wrapped)[-2:] == [("text", "laid out"), ("table", "| a | b |\n| --- | --- |\n| 1 |  |")]
    assert blocks_of("<p>a<p>b") == [("text", "a"), ("text", "b")] and blocks_of(None) == []
    assert blocks_of("<table><tr><td>Table of Contents</td></tr><tr><td><p>x</p></td></tr></table>") == []


def test_very_deep_pages_are_read():
    """Depth costs neither recursion nor a climb for every tag."""
    from folioflow.operators.blocks import blocks_of, tree

    deep = 100_000
    assert blocks_of("<div>" * deep + "<p>end</p>") == [("text", "end")] and blocks_of("<b>" * deep + "</i>" * deep + "<p>end") == [("text", "end")]
    assert blocks_of("<table><tr><td>" * deep + "<p>end</p>") == [("text", "end")] and blocks_of("<p>a<td>" * 5000)[-1] == ("text", "a")
    assert tree("<b>" * deep + "text" + "<a href=x>y</a>" * 10).text().endswith("y y")


def test_very_deep_pages_in_tasks(spark):
    deep = 20_000
    df = spark.createDataFrame([("<i>" * deep + '<table class="td"><tr><td><p>body <a href="u">link</a>',)], "html string")
    (r,) = df.select(page_parts("html").alias("p")).collect()
    assert list(r.p.paragraphs) == ["body link"] and r.p.anchors[0].row_text == "body link"


def test_body_html(spark):
    assert one(spark, body_html(F.col("h")), h="<div><table class='td'><p>x</p></table>").startswith("<table class='td'>")
    assert one(spark, body_html(F.col("h")), h="<table class='other'>") is None


def made_blocks(rng, doc):
    """(blocks, path of each word, tables): paragraphs of words that occur nowhere else, headings and tables."""
    blocks, path, where, tables, count = [], [], {}, [], 0
    for _ in range(int(rng.integers(0, 25))):
        kind = int(rng.integers(0, 12))
        if kind < 2:
            level = int(rng.integers(0, 2))
            heading = ["Chapter II Scope", "Annex III", "Introduction"][kind] if level == 0 else ["A. Short title", "3. Definitions apply"][kind]
            path = [*path[:level], heading]
            blocks.append(("text", heading))
        elif kind == 2:
            tables.append((list(path), "| a | b |\n| --- | --- |\n| " + "cell " * int(rng.integers(20, 90)) + "|"))
            blocks.append(("table", tables[-1][1]))
        else:
            said = []
            for _ in range(1 if kind > 3 else 14):
                words = [f"{'Wx'[i > 0]}{doc}q{count + i}" for i in range(int(rng.integers(16, 60)))]
                count += len(words)
                where.update(dict.fromkeys(words, list(path)))
                said.append(" ".join(words))
            blocks.append(("text", ". ".join(said)))
    return blocks, where, tables


def test_chunks_hold_every_word_once_in_order(spark):
    """The rules of packing: order, completeness, sizes, overlap, paths, and tables alone."""
    rng = np.random.default_rng(5)
    docs = [made_blocks(rng, i) for i in range(40)]
    df = spark.createDataFrame([(i, [{"kind": k, "text": t} for k, t in b]) for i, (b, _, _) in enumerate(docs)], f"i int, blocks {schemas.BLOCKS_TYPE}")
    got = {}
    for r in chunk(df).orderBy("i", "chunk_index").collect():
        assert r.n_chars == len(r.text) >= D.MIN_CHARS and (r.section is None) == (not r.section_path) and (r.section or "") == " > ".join(r.section_path)
        assert r.chunk_index == len(got.setdefault(r.i, []))
        got[r.i].append((r.section_path, r.text))
    assert sum(map(len, got.values())) > 100
    for i, (blocks, where, tables) in enumerate(docs):
        mine = got.get(i, [])
        assert [x for x in mine if x[1].startswith("|")] == [(p, t.strip()) for p, t in tables]
        longest = max((len(s) for k, t in blocks if k == "text" for s in ([t] if len(t) <= D.MAX_CHARS else t.split(". "))), default=0) + 1
        packed = [(p, t, [w.strip(".") for w in t.split()]) for p, t in mine if not t.startswith("|")]
        first_seen = list(dict.fromkeys(w for _, _, words in packed for w in words if w in where))
        assert first_seen == list(where)
        for (p, t, words), (q, _, nxt) in zip(packed, packed[1:], strict=False):
            again = [w for w in nxt if w in set(words)]
            assert again == nxt[: len(again)] and again == words[len(words) - len(again) :] and len(" ".join(again)) <= D.OVERLAP_CHARS and (not again or p == q)
        for p, t, words in packed:
            assert all(where[w] == p for w in words if w in where) and len(t) <= max(D.TARGET_CHARS + 1, D.OVERLAP_CHARS + 1 + longest)  # the line end after a tail is not counted


def test_long_tables_repeat_their_header(spark):
    md = "| h |\n| --- |\n" + "\n".join(f"| {i} {'x' * 50} |" for i in range(50))
    parts = one(spark, split_table(F.col("m"), 500), m=md)
    assert all(p.startswith("| h |\n| --- |\n") and len(p) <= 500 for p in parts)
    assert [x for p in parts for x in p.split("\n")[2:]] == md.split("\n")[2:]
    assert one(spark, split_table(F.col("m"), 500), m="| h |") == ["| h |"]


def test_empty_chunk_table(spark):
    none = spark.createDataFrame([], f"i int, blocks {schemas.BLOCKS_TYPE}")
    r = chunk_stats(chunk(none), "i").first()
    assert r.documents == 0 and r.median_chunks is None


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, applies_to array<string>")


def test_search_filters_before_ranking(spark):
    corpus = vectors(spark, [(1, [1.0, 0.0], ["a"]), (2, [0.9, 0.1], ["b"]), (3, [0.0, 1.0], []), (4, [0.5, 0.5], None), (5, [1.0, 0.0], ["a"]), (6, None, ["a"])])
    ask = lambda classes, k=10: [r.id for r in search.topk(corpus, spark.createDataFrame([(0, [1.0, 0.0], classes)], "query_id long, embedding array<float>, classes array<string>"), k).orderBy("rank").collect()]
    assert ask(None) == [1, 5, 2, 4, 3] and ask(["b"]) == [2, 4, 3] and ask(["a", "b"], 2) == [1, 5] and ask(["zzz"], 1) == [4] and ask(None, 0) == []


def test_headings_of_every_line(spark, tmp_path):
    from folioflow.plans import catalogue

    text = "Chapter II Applicability\n\n  3. Short Title\nplain words\n" + "1. The bank shall keep records. " * 8 + "\nPart 3\nAnnexure - IV\nSchedule of charges\nA. Short title\n3. short title\nChapters of a book\nINTRODUCTION "
    spark.createDataFrame([(1, text), (2, None), (3, "Preamble")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.queries()["heading_classify"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 0), (1, 3, 1), (1, 4, None), (1, 5, None), (1, 6, 0), (1, 7, 0), (1, 8, 0), (1, 9, 1), (1, 10, None), (1, 11, None), (1, 12, 0), (3, 1, 0)]


def test_dates_numbers_departments(spark):
    dates = {"Mumbai, August 6, 2026": "2026-08-06", "Feb 03, 2026": "2026-02-03", "Sept 6, 2026": None, "Foo 6, 2026 and 01.02.2026": None, "31.02.2026": None, "dated 6.8.2026": "2026-08-06", "January 31,2025": "2025-01-31", "none": None}
    assert [one(spark, X.iso_date(F.col("t")), t=t) for t in dates] == list(dates.values())
    assert one(spark, X.raw_date(F.col("t")), t="Foo 6, 2026 and 01.02.2026") == "Foo 6, 2026"
    assert one(spark, X.number_of(F.col("t")), t="RBI/DOR/2026-27/213 x RBI/2020-21/1") == "RBI/DOR/2026-27/213" and one(spark, X.number_of(F.col("t")), t="RBI/x") is None
    refs = {"CO.DGBA.GBD.No.S228/42": "DGBA", "REF.No.MPD.BC.401": "MPD", "DCM(Plg) No.S737": "DCM", "A.P. (DIR Series) Circular No. 15": "AP-DIR", "RBI/CO.DPSS.POLC.No.1/02": "DPSS", "12/34": None, "DoS.CO.PPG.47": "DOS"}
    assert [one(spark, X.department(F.lit("RBI/2025-26/1"), F.col("t")), t=t) for t in refs] == list(refs.values())
    assert one(spark, X.department(F.col("n"), F.lit("x")), n="RBI/dor/2026-27/2") == "DOR"


def test_classes_of_titles(spark):
    binds = lambda s, m=None: one(spark, X.applies_to(F.lit(s), F.lit(m).cast("string")), x=1)
    assert binds("Reserve Bank of India (Payments Banks - Conduct) Directions, 2025") == ["Payments Banks"] and binds("Compliance with norms", "All Authorised Persons") == ["Authorised Persons"]
    assert binds("Penal Interest", "All banks,") == [D.ALL_BANKS] and binds(None) == [] and binds("x", "All Standalone Primary Dealers") == ["Standalone Primary Dealers", "Primary Dealers"]
    assert binds("Reserve Bank of India [Small Finance Banks, excluding NBFCs] Directions", "All Scheduled Commercial Banks") == ["Small Finance Banks", "Commercial Banks"]


def test_search_takes_queries_in_blocks(spark, monkeypatch):
    corpus = vectors(spark, [(i, [float(i % 7), float(i % 5 + 1)], [str(i % 3)] if i % 4 else None) for i in range(60)])
    queries = corpus.filter("id % 5 = 0").selectExpr("id AS query_id", "embedding", "CASE WHEN id % 2 = 0 THEN array('1') END AS classes")
    whole = sorted(map(tuple, search.topk(corpus, queries, 4, exclude_self=True).select("query_id", "rank", "id", "sim").collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "CORPUS_BLOCK", 7)
    blocks = sorted(map(tuple, search.topk(corpus, queries, 4, exclude_self=True).select("query_id", "rank", "id", "sim").collect()))
    assert blocks == whole and len(whole) == 4 * 12 and search.topk(corpus, queries.limit(0), 4).count() == 0 == search.topk(corpus.limit(0), queries, 4).count()
    plan = search.topk(corpus, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "LocalRelation" not in plan and "Union" not in plan  # one job over all blocks, nothing from the driver


def test_queries_grow_with_the_table(spark):
    from folioflow.plans import catalogue

    got = catalogue.queries()["topk_unfiltered"](spark, "/root/testdata/sf0.1")
    assert sorted({r.query_id for r in got.collect()}) == list(range(0, 2000, 100)) and got.count() == 200


def test_verification_outcomes(spark):
    cites = [{"source_id": 1, "quote": "The  BANK\nshall"}, {"source_id": 2, "quote": "the bank shall"}, {"source_id": 9, "quote": "second"}, {"source_id": 0, "quote": ""}, {"source_id": 1, "quote": "absent"}]
    df = spark.createDataFrame([(cites, ["the bank shall keep", "a second one"], ["n1", "n2"])], "c array<struct<source_id:int,quote:string>>, t array<string>, n array<string>")
    got = df.select(verify(F.col("c"), F.col("t"), F.col("n")).alias("v")).first()["v"]
    assert [(v.status, v.found_in, v.cited_doc) for v in got] == [("ok", [1], "n1"), ("wrong_source", [1], "n2"), ("wrong_source", [2], None), ("not_found", [], None), ("not_found", [], "n1")]


from folioflow.operators.containment import containment  # noqa: E402


def test_containment_finds_quotes_inside_words(spark):
    texts = spark.createDataFrame([(1, "xx Alpha beta gamma delta epsilon zeta yy"), (2, "alpha beta"), (3, None)], "t long, text string")
    quotes = spark.createDataFrame([(1, "pha beta  gamma delta epsilon ze"), (2, "BETA"), (3, ""), (4, None)], "q long, text string")
    assert sorted(map(tuple, containment(texts, quotes, "t", "q").collect())) == [(1, 1), (1, 2), (2, 2)]


def test_upsert_takes_given_columns_only(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, n int, s string")
    delta = spark.createDataFrame([("b", None), ("c", 3)], "key string, n int")
    assert sorted(map(tuple, store.upsert(table, delta).collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, None)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("k1", "2026-02-03", "DOR", ["A", "B"], "p"), ("k2", None, None, [], None)], "number string, issue_date string, department string, applies_to array<string>, local_path string").withColumns({"meant_for": F.lit(None).cast("string"), "subject": F.lit("s")})
    assert sorted((r.kind, r.category) for r in store.circular_categories(docs).collect()) == [("department", "DOR"), ("entity", "A"), ("entity", "B")]
    store.write_dated(docs, f"{tmp_path}/dated")
    assert sorted((r.year, r.month) for r in spark.read.parquet(f"{tmp_path}/dated").selectExpr("CAST(year AS string) year", "lpad(CAST(month AS string), 2, '0') month").collect()) == [("2026", "02"), ("undated", "00")]
    store.write_categories(docs, f"{tmp_path}/cats")
    store.write_csv(docs, f"{tmp_path}/csv")
    assert [r.applies_to for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()] == ["A; B", None]


def test_collection_ask_and_history(spark, tmp_path):
    text = "Payments Banks shall verify the identity of every customer before opening an account. Records are kept for five years."
    docs = spark.createDataFrame([("d1", "N1", ["Payments Banks"], [{"kind": "text", "text": text}]), ("d2", "N2", ["Local Area Banks"], [{"kind": "text", "text": text.replace("Payments", "Local Area")}])], f"doc_key string, number string, applies_to array<string>, blocks {schemas.BLOCKS_TYPE}")
    chunks = schemas.migrate(with_ids(chunk(docs)), schemas.CHUNKS_DDL)
    assert store.build_collection(chunks, embed(chunks.select("chunk_id", "text"), HashingEmbedder()), f"{tmp_path}/c") == 2
    index = spark.read.parquet(f"{tmp_path}/c")
    asked = spark.createDataFrame([(0, "What must Payments Banks verify before opening an account for a customer?"), (1, "zebra quantum?")], "query_id long, question string")
    log = A.answer(asked, index, HashingEmbedder(), ExtractiveGenerator(), NOW(), "r1")
    store.append_log(log, f"{tmp_path}/log")
    store.append_log(log.withColumn("error", F.lit("Broken: x")), f"{tmp_path}/log")
    rows = sorted(log.collect(), key=lambda r: r.seq)
    assert rows[0].retrieved == ["N1"] and rows[0].filtered and rows[0].verified == rows[0].n_citations > 0 and rows[1].insufficient_context and not rows[1].filtered
    h = A.history(spark.read.parquet(f"{tmp_path}/log")).first()
    assert (h.logged, h.answered, h.insufficient, h.verified_percent) == (4, 2, 1, 100)
    assert A.batch_summary(log).first().asked == 2


def test_a_batch_stops_when_the_quota_is_gone(spark):
    class Meter:
        """A generator whose quota ends at a question that says so."""

        name = "meter"

        def answer(self, question, sources):
            if "stop" in question:
                raise QuotaExhausted("429")
            return {"answer": "x", "citations": [], "insufficient_context": True}

    index = embed(spark.createDataFrame([(1, "some text", "n", None, ["a"], "s", None)], "chunk_id long, text string, number string, issue_date string, applies_to array<string>, subject string, section string"), HashingEmbedder())
    asked = spark.createDataFrame([(i, "stop here" if i in (5, 6) else f"question {i}") for i in range(12)], "query_id long, question string").coalesce(1)
    log = A.answer_batch(asked, index, HashingEmbedder(), Meter(), NOW(), "r", block=4)
    got = sorted((r.seq, r.error) for r in log.collect())
    assert [s for s, e in got if e is None and s < 4] == [0, 1, 2, 3] and all(s < 8 for s, _ in got) and A.NOT_ASKED not in {e for _, e in got}
    assert {e for _, e in got if e} == {"QuotaExhausted: 429"} and A.batch_summary(log).first().answered == sum(e is None for _, e in got)
    whole = A.answer_batch(asked.filter("query_id > 6"), index, HashingEmbedder(), Meter(), NOW(), "r", block=2)
    assert whole.count() == 5 and A.answer_batch(asked.limit(0), index, HashingEmbedder(), Meter(), NOW(), "r").count() == 0


def test_a_batch_searches_its_index_once(spark, monkeypatch):
    """Whatever the number of blocks; and questions that share an id have sources of their own."""
    rows = [(i, text, f"n{i}", None, None, "s", None) for i, text in enumerate(["capital of banks", "records of customers", "accounts and deposits"])]
    index = embed(spark.createDataFrame(rows, "chunk_id long, text string, number string, issue_date string, applies_to array<string>, subject string, section string"), HashingEmbedder())
    asked = spark.createDataFrame([(i // 2, q) for i, q in enumerate(["capital of banks", "records of customers", "accounts and deposits", "capital of banks", "records of customers"])] + [(None, "capital of banks")], "query_id long, question string")
    searches, topk = [], A.topk
    monkeypatch.setattr(A, "topk", lambda *x: searches.append(x) or topk(*x))
    log = A.answer_batch(asked, index, HashingEmbedder(), ExtractiveGenerator(), NOW(), "r", k=1, block=2)
    got = sorted(((r.seq, r.question, r.retrieved) for r in log.collect()), key=str)
    own = {"capital of banks": ["n0"], "records of customers": ["n1"], "accounts and deposits": ["n2"]}
    assert len(searches) == 1 and got == sorted(((r.query_id, r.question, own[r.question]) for r in asked.collect()), key=str)


def test_vectors_of_a_batch_are_those_of_each_text():
    texts = ["Banks, banks and (bank)", "", None, "...", " \n", "one", "a b a b", "Ünï ſ ß"] * 100
    one_by_one = [HashingEmbedder(16).encode([t])[0].tolist() for t in texts]
    assert HashingEmbedder(16).encode(texts).tolist() == one_by_one and HashingEmbedder(16).encode([]).shape == (0, 16)


def test_chunks_are_trimmed_of_all_white_space(spark):
    import re as python_re

    from folioflow.operators.chunk import WHITE

    every = spark.range(0x10000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert {r.c for r in every.filter(F.col("c").rlike(r"(?U)^\s$")).collect()} == set(WHITE)
    text = f"{WHITE}{'word ' * 30}end{WHITE}"
    docs = spark.createDataFrame([("d", [{"kind": "table", "text": text}, {"kind": "text", "text": text}])], f"doc_key string, blocks {schemas.BLOCKS_TYPE}")
    assert {r.text for r in chunk(docs).collect()} == {"word " * 30 + "end"} and python_re.sub(r"^\s+|\s+$", "", text) == "word " * 30 + "end"


def test_refusals_of_a_service():
    from folioflow.operators.generate import failure

    assert isinstance(failure(429, ""), QuotaExhausted) and isinstance(failure(400, "RESOURCE_EXHAUSTED"), QuotaExhausted) and type(failure(404, "gone")) is RuntimeError
    busy = failure(503, "{'retryDelay': '7s'}")
    assert isinstance(busy, Transient) and busy.delay == 7 and failure(500, "x").delay is None and isinstance(failure(400, "UNAVAILABLE"), Transient)


def test_a_remote_generator():
    import http.server
    import json
    import threading

    from folioflow.operators.generate import RemoteGenerator

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            gone = "quota" in asked["prompt"]
            body = json.dumps({"answer": asked["model"], "citations": [{"source_id": 1, "quote": "a"}], "insufficient_context": False}).encode()
            self.send_response(429 if gone else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        g = RemoteGenerator(f"http://127.0.0.1:{server.server_port}/", "m1", "k")
        assert g.answer("q", ["a"]) == {"answer": "m1", "citations": [{"source_id": 1, "quote": "a"}], "insufficient_context": False}
        with pytest.raises(QuotaExhausted):
            g.answer("quota", ["a"])
    finally:
        server.shutdown()


def test_a_log_of_two_runs_is_in_order_of_time(spark):
    day = lambda d: datetime.datetime(2026, 1, d)
    rows = [(0, day(2), "b", None), (1, day(2), "b", None), (0, day(1), "z", None), (1, day(1), "z", "Broken"), (0, day(3), "a", None)]
    log = spark.createDataFrame(rows, "seq long, timestamp timestamp, run_id string, error string").withColumns({"insufficient_context": F.lit(False), "verified": F.lit(1), "n_citations": F.lit(2)})
    h = A.history(log).first()
    assert (h.first_date, h.last_date, h.logged, h.answered) == ("2026-01-01", "2026-01-03", 5, 4)
    assert [(r.run_id, r.seq) for r in A.tail(log, 3).collect()] == [("b", 0), ("b", 1), ("a", 0)]


def test_generation_errors_and_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Transient("busy", 0.5)
        return {"answer": "x"}

    waits = []
    assert with_retry(flaky, sleep=waits.append) == {"answer": "x"} and waits == [0.5, 0.5]

    def gone():
        raise QuotaExhausted("no more")

    with pytest.raises(QuotaExhausted):
        with_retry(gone, sleep=waits.append)


def test_answer_json_and_models(spark):
    df = spark.createDataFrame([('{"answer": "a", "citations": [{"source_id": 1, "quote": "q"}], "insufficient_context": false}',)], "json string")
    assert decode_answers(df).first().reply.citations[0].quote == "q"
    models = [{"name": "models/b", "actions": ["generateContent"]}, {"name": "models/a", "actions": ["embed"]}, {"name": "models/c"}]
    assert [r.name for r in list_models(spark, models, "b").collect()] == ["b", "c"] and list_models(spark, models, "b", True).count() == 3


def test_short_lists_of_questions(spark, tmp_path):
    from folioflow.__main__ import entity_queries, questions

    asked = entity_queries(spark).filter(F.array_contains(A.detect_entities(F.col("question")), F.col("class")))
    assert sorted(r["class"] for r in asked.collect()) == sorted(D.ASKED_CLASSES)
    (tmp_path / "q.json").write_text('{"question": "x", "class": "y"}\n')
    assert [tuple(r)[:2] for r in entity_queries(spark, str(tmp_path / "q.json")).collect()] == [("x", "y")]
    assert [r.question for r in questions(spark).collect()] == D.SAMPLE_QUESTIONS


def test_config_and_tracing():
    env = {"A": "kept"}
    assert config.parse("# c\nexport B='x y'\nA=1\nbad") == {"B": "x y", "A": "1"} and config.load("/nonexistent/.env", env) == {}
    assert config.summary(["API_KEY", "B"], {"API_KEY": "secret-value", "B": "b"}) == {"API_KEY": "sec...12 characters", "B": "b"}
    spans = []
    tracing.configure(lambda s: spans.append(s) or 1 / 0)
    with tracing.observe("step") as s:
        s["note"] = "n"
    tracing.configure(None)
    assert spans[0]["name"] == "step" and spans[0]["note"] == "n" and not tracing.enabled()


def test_clean_text_and_overlap(spark):
    assert X.clean_text("ﬁn​al \t  x\n y ") == "final x\n y"
    assert one(spark, X.overlap_tail(F.col("t")), t="word " * 40 + "end").startswith("word")
    assert one(spark, X.overlap_tail(F.col("t")), t="short") is None


def test_crawl_source_reads_a_folder(spark, tmp_path):
    from folioflow.sources.crawl import PagesById

    for i in (5, 3):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}</p>")
    spark.dataSource.register(PagesById)
    got = spark.read.format("pages_by_id").options(url=f"file://{tmp_path}/{{id}}.html", start="6", back="5").load()
    assert sorted((r.rbi_id, r.html) for r in got.collect()) == [(3, "<p>3</p>"), (5, "<p>5</p>")]


def test_only_missing_bodies_are_fetched(spark, tmp_path):
    from folioflow.operators import fetch as N

    for i in (1, 2, 3):
        (tmp_path / f"{i}.html").write_bytes(f"<p>x</p><table class='td'><p>body {i} \xff".encode("latin-1") if i < 3 else b"<p>no table</p>")
    rows = [(f"c{i}", "circular", f"file://{tmp_path}/{i}.html", None) for i in (1, 2, 3, 9)] + [("d", "master_direction", f"file://{tmp_path}/1.html", None), ("e", "circular", f"file://{tmp_path}/1.html", "kept")]
    docs = spark.createDataFrame(rows, "key string, doc_type string, source_url string, body_path string")
    got = {r.key: r.html for r in N.bodies(docs, delay=0).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"].startswith("<table class='td'><p>body 1")
    kept = spark.createDataFrame([("c1",)], "key string")
    assert [r.key for r in N.bodies(docs, kept, delay=0).collect()] == ["c2"]


def test_downloads_are_checked_and_kept_by_date(spark, tmp_path):
    from folioflow.operators import fetch as N

    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4 content")
    (tmp_path / "wall.pdf").write_bytes(b"<html>are you a robot</html>")
    (tmp_path / "page.html").write_text(f'<a href="/rdocs/content/pdfs/Utkarsh.pdf">u</a><a href="http://rbidocs.rbi.org.in/rdocs/Notification/none.pdf">n</a>')
    (tmp_path / "bare.html").write_text("<p>no link</p>")
    url = lambda n: f"file://{tmp_path}/{n}"
    rows = [("a", "RBI/2025-26/1", "s", "2025-11-28", url("page.html"), url("good.pdf"), None), ("b", None, " ", None, None, url("good.pdf"), None), ("c", "n", None, None, None, url("wall.pdf"), None),
            ("d", "n", None, None, url("bare.html"), None, None), ("e", "n", None, None, None, url("absent.pdf"), None), ("f", "n", None, None, None, url("good.pdf"), "kept")]
    docs = spark.createDataFrame(rows, "key string, number string, subject string, issue_date string, source_url string, pdf_url string, local_path string")
    got = {r.key: r for r in N.download(docs, f"{tmp_path}/pdfs", delay=0).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "saved", "b": "saved", "c": "not a pdf", "d": "no link", "e": "failed"}
    assert got["a"].local_path.endswith("pdfs/year=2025/month=11/RBI_2025-26_1.pdf") and got["b"].local_path.endswith("year=undated/month=00/b.pdf") and got["c"].local_path is None
    kept = spark.read.parquet(f"{tmp_path}/pdfs").collect()
    assert sorted(r.key for r in kept) == ["a", "b"] and {bytes(r.content) for r in kept} == {b"%PDF-1.4 content"}
    found = N.resolved(docs.filter("key = 'd'").withColumn("source_url", F.lit(url("page.html"))), delay=0).first()
    assert found.pdf_url == "http://rbidocs.rbi.org.in/rdocs/Notification/none.pdf"


def test_a_docs_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    from folioflow.__main__ import _docs

    assert _docs(spark, str(tmp_path)).count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception, match="."):
        _docs(spark, str(tmp_path)).count()


def test_the_command_line_from_pages_to_answers(spark, tmp_path, monkeypatch, capsys):
    from folioflow import __main__ as cli

    text = "Payments Banks shall verify the identity of every customer before opening an account. Records are kept for five years. " * 2
    for i in (5, 6):
        html = page(f"RBI/2025-26/{i}", "November 28, 2025", "All Payments Banks", "Madam / Sir,", "Reserve Bank of India (Payments Banks – Conduct) Directions, 2025", text)
        (tmp_path / f"{i}.html").write_text(html)
    (tmp_path / "asked.txt").write_text("What must Payments Banks verify before opening an account?\n\nHow long are records kept?\n")
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("FOLIO_TEST_SETTING=1\n")
    monkeypatch.setattr(cli.config, "load", lambda: None)
    monkeypatch.setattr(cli.D, "DETAIL_URL", f"file://{tmp_path}/")
    run = lambda *args: cli.main([*args, "--data", str(tmp_path / "data"), "--delay", "0"])
    run("harvest", "--url", f"file://{tmp_path}/{{id}}.html", "--start", "6", "--back", "4")
    docs = spark.read.parquet(f"{tmp_path}/data/docs")
    assert sorted(r.key for r in docs.collect()) == ["circular:5", "circular:6"]
    docs = docs.withColumn("source_url", F.concat(F.lit(f"file://{tmp_path}/"), F.col("rbi_id").cast("string"), F.lit(".html")))
    cli._write_swapped(docs, f"{tmp_path}/data/docs")
    run("text")
    (tmp_path / "5.html").unlink()
    (tmp_path / "7.html").write_text(page("RBI/2025-26/7", "November 29, 2025"))
    run("harvest", "--resume", "--url", f"file://{tmp_path}/{{id}}.html", "--start", "8", "--back", "5")
    assert spark.read.parquet(f"{tmp_path}/data/docs").count() == 3
    run("text")
    bodies = spark.read.parquet(f"{tmp_path}/data/bodies")
    assert bodies.count() == bodies.select("key").distinct().count() == 2
    run("chunk")
    run("build", "--approximate")
    run("entity-test", "--approximate")
    run("batch", "--questions", str(tmp_path / "asked.txt"))
    run("ask", "How long are records kept?")
    run("history")
    log = spark.read.parquet(f"{tmp_path}/data/log").collect()
    assert len(log) == 3 and len({r.run_id for r in log}) == 2 and all(r.error is None for r in log) and spark.read.json(f"{tmp_path}/data/batch").count() == 2
    spans = spark.read.parquet(f"{tmp_path}/data/spans").collect()
    assert {"harvest", "text", "chunk", "build", "batch", "ask", "history"} <= {r.name for r in spans} and any(r.kind == "generation" for r in spans)
    run("download")
    assert "no link" in capsys.readouterr().out


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from folioflow.plans import materialize

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        materialize.shared_dir(Unset())


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports without the subpackage, and doesn't hide errors inside it."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("folioflow", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(tmp_path / "folioflow" / "llm", ignore_errors=True)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    done = run()
    assert done.returncode == 0 and done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 50
    (tmp_path / "folioflow" / "llm").mkdir()
    (tmp_path / "folioflow" / "llm" / "__init__.py").write_text("")
    (tmp_path / "folioflow" / "llm" / "registry.py").write_text("import a_module_that_is_missing")
    assert run().returncode != 0


def test_files(spark, tmp_path):
    from folioflow.sources import files

    (tmp_path / "circular_12.html").write_text("<p>x</p>\n<p>y</p>")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    assert [(r.rbi_id, r.html) for r in files.read_bodies(spark, f"file://{tmp_path}/*.html").collect()] == [(12, "<p>x</p>\n<p>y</p>")]
    assert files.read_pdfs(spark, f"file://{tmp_path}").count() == 1


def test_stream_upserts_over_two_runs(spark, tmp_path):
    from folioflow.streaming.ingest import current, read_stream, upsert_stream

    write = lambda rows: spark.createDataFrame(rows, "key long, n int, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
    t = lambda d: datetime.datetime(2026, 1, d)
    run = lambda: upsert_stream(read_stream(spark, f"{tmp_path}/in", schemas.struct("key long, n int, ts timestamp")), f"file://{tmp_path}/t", f"file://{tmp_path}/cp", "key", "ts").awaitTermination()
    write([(1, 1, t(1)), (1, 2, t(2)), (2, 5, t(1))])
    run()
    write([(2, 6, t(3)), (3, 7, t(1))])
    run()
    assert sorted((r.key, r.n) for r in current(spark, f"file://{tmp_path}/t").collect()) == [(1, 2), (2, 6), (3, 7)]
    write([(1, 99, datetime.datetime(2025, 1, 1)), (3, 8, t(1)), (4, 1, t(1))])  # a late row changes nothing, one of the same time does
    run()
    assert sorted((r.key, r.n) for r in current(spark, f"file://{tmp_path}/t").collect()) == [(1, 2), (2, 6), (3, 8), (4, 1)]
    kept = versions(spark, f"file://{tmp_path}/t")
    assert len(kept) <= 4 and all(len(v) <= 2 for v in kept.values())


def test_classes_are_those_of_the_sql(spark):
    """Edges of words, white space and letters of either case as in the SQL, next to letters outside ASCII too."""
    import duckdb

    from folioflow.plans.documents import _scan_sql

    texts = ["ñarc", "éUCB x", "UCBſ", "UCBsé", "SFB_", "forEıgn banks", "foreıgn banks", "foreIgn banK", "urban\x0bcooperative banks", "urban\x85cooperative banks", "urban\ncooperative banK", "AD category-\tI", "aD category Í", "houſing finance company", "ﬀARCs", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.scan_entities(F.col("t")).alias("found")).collect()
    want = [duckdb.execute(f"SELECT {_scan_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in texts]
    assert [r.found for r in sorted(got)] == want and ["Asset Reconstruction Companies"] in want


def test_queries_begin_with_bounded_batches(spark):
    """Python workers get batches of bounded size from every query of the library, not of Spark's default."""
    from folioflow import session
    from folioflow.plans import catalogue

    before = spark.conf.get(session.ARROW_BYTES)
    try:
        for name in ("page_anchors", "text_clean", "quote_reach", "table_blocks"):
            spark.conf.set(session.ARROW_BYTES, "67108864b")
            catalogue.queries()[name](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(session.ARROW_BYTES) == session.BATCH
    finally:
        spark.conf.set(session.ARROW_BYTES, before)


def test_a_table_is_told_once(monkeypatch):
    """What a table is for is found out once a table, and nothing counts the lines of a page."""
    from folioflow.operators import blocks

    asked = []
    told = blocks.is_contents
    monkeypatch.setattr(blocks, "is_contents", lambda table: asked.append(table) or told(table))
    assert blocks_of("<table><tr><td>h<td>i</table>" * 3) == [("table", "| h | i |\n| --- | --- |")] * 3 and len(asked) == 3


def test_a_collection_embeds_each_chunk_once(spark, tmp_path):
    """Finding the ranges of a collection doesn't make its vectors again."""
    made = spark.sparkContext.accumulator(0)

    def vector(chunk_id):
        made.add(1)
        return [1.0, float(chunk_id)]

    chunks = schemas.migrate(spark.createDataFrame([(i, f"d{i % 3}") for i in range(40)], "chunk_id long, department string"), schemas.CHUNKS_DDL)
    vectors = chunks.select("chunk_id", F.udf(vector, "array<float>")("chunk_id").alias("embedding"))
    assert store.build_collection(chunks, vectors, f"file://{tmp_path}/c") == 40 and made.value == 40


def test_a_collection_is_not_broadcast(spark, tmp_path, monkeypatch):
    """However small the files of the chunks are: neither texts nor vectors pass through the driver."""
    joined, spill = [], store.spill
    monkeypatch.setattr(store, "spill", lambda df, tag: joined.append(df) or spill(df, tag))
    chunks = schemas.migrate(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "chunk_id long, text string"), schemas.CHUNKS_DDL)
    chunks.write.parquet(f"file://{tmp_path}/chunks")
    chunks = spark.read.parquet(f"file://{tmp_path}/chunks")
    assert store.build_collection(chunks, embed(chunks.select("chunk_id", "text"), HashingEmbedder()), f"file://{tmp_path}/c") == 40
    (points,) = joined
    assert len(points.collect()) == 40  # the plan is then the one that ran
    assert "Broadcast" not in points._jdf.queryExecution().executedPlan().toString()


def test_a_long_batch_takes_few_blocks(spark, monkeypatch):
    """Each block has as many questions as those before it; a refused task asks nothing more, in its later Arrow batches neither."""
    from contextlib import contextmanager

    class Meter:
        name = "meter"

        def answer(self, question, sources):
            if "stop" in question:
                raise QuotaExhausted("429")
            return {"answer": "x", "citations": [], "insufficient_context": True}

    named = []

    @contextmanager
    def observed(name, *_):
        named.append(name)
        yield {}

    monkeypatch.setattr(A, "observe", observed)
    index = embed(spark.createDataFrame([(1, "some text", "n", None, ["a"], "s", None)], "chunk_id long, text string, number string, issue_date string, applies_to array<string>, subject string, section string"), HashingEmbedder())
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("question "), "id").alias("question"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        log = A.answer_batch(asked, index, HashingEmbedder(), Meter(), NOW(), "r", block=3)
        assert sorted(r.seq for r in log.collect()) == list(range(40))
        assert named == ["answers 1 to 3", "answers 4 to 6", "answers 7 to 12", "answers 13 to 24", "answers 25 to 40"]
        over = A.answer_batch(asked.withColumn("question", F.lit("stop")), index, HashingEmbedder(), Meter(), NOW(), "r", block=30)
        assert [r.error for r in over.collect()] == ["QuotaExhausted: 429"]  # one task, one refusal
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
