"""Every library query with SQL gives the rows that DuckDB gives."""

import pytest
from helpers import spark_rows, sql_rows

from folioflow.plans import catalogue

SMALL = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, SMALL)) == sql_rows(SQL[name], SMALL)


def test_answers(spark):
    """The answering queries have no SQL: their records are held against the tables."""
    assert set(catalogue.queries()) - set(SQL) == {"ask_pipeline", "batch_pipeline", "ann_topk"}
    (record,) = catalogue.queries()["ask_pipeline"](spark, SMALL).collect()
    assert len(record.retrieved) == 8 and record.error is None and record.n_citations == len(record.citations)
    assert record.verified == sum(c.status == "ok" for c in record.citations) == record.n_citations
    (summary,) = catalogue.queries()["batch_pipeline"](spark, SMALL).collect()
    due = spark.read.parquet(f"{SMALL}/conversations.parquet").filter("role = 'user' AND text IS NOT NULL AND conv_id % 100 = 0").count()
    assert summary.asked == summary.answered == due > 0 and summary.wrong_source == summary.not_found == 0


def test_answers_against_a_plain_version(spark):
    """Every answer of the batch, from a search over all vectors in numpy, the generator called by hand, and quotes looked up as substrings."""
    import numpy as np

    from folioflow import dictionaries as D
    from folioflow.operators.embed import HashingEmbedder
    from folioflow.operators.generate import ExtractiveGenerator
    from folioflow.plans import documents

    index = documents.document_index(spark, SMALL).select("chunk_id", "number", "text", "embedding").toPandas().sort_values("chunk_id").reset_index(drop=True)
    vectors = np.stack(index["embedding"]).astype(np.float64)
    plain = lambda t: " ".join(t.lower().split())
    records = documents._answers(spark, SMALL, "conv_id % 100 = 0", "batch").collect()
    assert records
    for r in records:
        q = HashingEmbedder().encode([D.QUERY_PREFIX + r.question])[0].astype(np.float64)
        best = np.argsort(-np.round(vectors @ q, 6), kind="stable")[:8]
        reply = ExtractiveGenerator().answer(r.question, index["text"][best].tolist())
        assert list(r.retrieved) == index["number"][best].tolist() and not r.filtered
        assert (r.answer, r.insufficient_context, r.n_citations) == (reply["answer"], reply["insufficient_context"], len(reply["citations"]))
        for got, want in zip(r.citations, reply["citations"], strict=True):
            inside = [n for n, t in enumerate(index["text"][best], 1) if plain(want["quote"]) in plain(t)]
            assert (got.source_id, got.quote, list(got.found_in)) == (want["source_id"], want["quote"], inside) and got.status == "ok"
        assert r.verified == len(reply["citations"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10 * 5  # queries: the ids below 500 divisible by 100


def test_a_batch_answers_every_question(spark):
    """What users say in any conversation is asked, not a part of it."""
    asked = spark.read.parquet(f"{SMALL}/conversations.parquet").filter("role = 'user' AND text IS NOT NULL").count()
    (summary,) = catalogue.queries()["batch_pipeline"](spark, SMALL).collect()
    assert summary.asked == summary.answered == asked > 30 and summary.wrong_source == summary.not_found == 0
