"""Similarity queries over the table embeddings: a label is a class. The queries are the rows whose id is divisible by 100, at any size of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.vectors import dot, entity_filter
from folioflow.operators import ann, search
from folioflow.plans.materialize import shared_dir, spill
from folioflow.plans.registry import Registry
from folioflow.sources.tables import read_table
from folioflow.sources.vectors import VectorFiles, in_ranges

R = Registry()
DUE = "vec_id % 100 = 0"

_CORPUS = """
WITH corpus AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {applies} AS applies_to FROM embeddings),
asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label::VARCHAR AS class FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, id, applies_to, class, round(list_inner_product(c.v, q.v), 6) AS sim FROM corpus c, asked q WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM scored)
"""
_LABEL = "[label::VARCHAR]"
_SOME = "CASE WHEN embedding[1]::DOUBLE > 0.15 THEN [] ELSE [label::VARCHAR] END"
_TOP = _CORPUS + "SELECT query_id, rank::BIGINT AS rank, id, sim FROM ranked WHERE rank <= 10"


def _no_class():
    """Vectors taken to bind no class."""
    return F.col("embedding")[0].cast("double") > 0.15


def corpus(spark: SparkSession, sf_dir: str, unscoped: bool = False) -> DataFrame:
    label = F.array(F.col("label").cast("string"))
    applies = F.when(_no_class(), F.array().cast("array<string>")).otherwise(label) if unscoped else label
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", applies.alias("applies_to"))


def asked(spark: SparkSession, sf_dir: str, classes=None) -> DataFrame:
    q = read_table(spark, sf_dir, "embeddings").filter(DUE)
    label = F.col("label").cast("string")
    none = F.lit(None).cast("array<string>")
    return q.select(F.col("vec_id").alias("query_id"), "embedding", label.alias("class"), (none if classes is None else classes(label)).alias("classes"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "sim")


@R.add(_TOP.format(applies=_LABEL, where="true"))
def topk_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(corpus(spark, sf_dir), asked(spark, sf_dir), 10))


@R.add(_TOP.format(applies=_LABEL, where="list_contains(applies_to, class)"))
def topk_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(corpus(spark, sf_dir), asked(spark, sf_dir, lambda c: F.array(c)), 10))


@R.add(_TOP.format(applies=_LABEL, where="list_has_any(applies_to, [class, '3'])"))
def topk_multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(corpus(spark, sf_dir), asked(spark, sf_dir, lambda c: F.array(c, F.lit("3"))), 10))


@R.add(_TOP.format(applies=_SOME, where="len(applies_to) = 0 OR list_contains(applies_to, class)"))
def topk_or_unscoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(corpus(spark, sf_dir, unscoped=True), asked(spark, sf_dir, lambda c: F.array(c)), 10))


@R.add(_TOP.format(applies=_LABEL, where="list_contains(applies_to, class) AND c.v[2] > 0.2"))
def topk_short_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrow predicate of the query itself leaves fewer rows than k; the result is short, not padded."""
    return _shown(search.topk(corpus(spark, sf_dir).filter("CAST(embedding[1] AS DOUBLE) > 0.2"), asked(spark, sf_dir, lambda c: F.array(c)), 10))


_PRECISION = """, hits AS (SELECT query_id, list_contains(applies_to, class)::INT AS hit FROM ranked WHERE rank <= 10)
SELECT query_id, sum(hit)::BIGINT AS hits, count(*) AS returned, sum(hit) / greatest(count(*), 1) AS precision FROM hits GROUP BY ROLLUP (query_id)"""


@R.add(_CORPUS.format(applies=_LABEL, where="id <> query_id") + _PRECISION)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir)
    return search.precision(search.topk(corpus(spark, sf_dir), q, 10, exclude_self=True), q)


@R.add(_CORPUS.format(applies=_SOME, where="id <> query_id AND (len(applies_to) = 0 OR list_contains(applies_to, class))") + _PRECISION)
def precision_at_k_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir, lambda c: F.array(c))
    return search.precision(search.topk(corpus(spark, sf_dir, unscoped=True), q, 10, exclude_self=True), q)


@R.add(_CORPUS.format(applies=_LABEL, where="id <> query_id") + "SELECT query_id, rank::BIGINT AS rank, id, sim FROM ranked WHERE rank <= 5")
def neighbour_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(corpus(spark, sf_dir), asked(spark, sf_dir), 5, exclude_self=True))


@R.add(_CORPUS.replace("WHERE vec_id % 100 = 0", "ORDER BY md5(vec_id::VARCHAR || ':0'), vec_id LIMIT 6").format(applies=_LABEL, where="id <> query_id") + "SELECT query_id, rank::BIGINT AS rank, id, sim FROM ranked WHERE rank <= 5")
def neighbour_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of six rows drawn by a hash: a sample is the feature."""
    return _shown(search.probe(corpus(spark, sf_dir)))


@R.add(_CORPUS.format(applies=_LABEL, where="true") + "SELECT query_id, rank::BIGINT AS rank, id, CASE WHEN list_contains(applies_to, class) THEN 'OK' ELSE '--' END AS flag FROM ranked WHERE rank <= 10 AND query_id = 0")
def worked_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir).filter("query_id = 0")
    return search.worked_example(search.topk(corpus(spark, sf_dir), q, 10), q).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "flag")


def _found_by_codes(spark: SparkSession, sf_dir: str, classes=None) -> tuple[DataFrame, DataFrame]:
    """What the approximate index and the exact search find for the same queries."""
    rows, q = corpus(spark, sf_dir), asked(spark, sf_dir, classes)
    model = ann.fit(rows)
    return ann.search(rows, spill(ann.index(rows, model), "ann-index"), q, model, 10), search.topk(rows, q, 10)


@R.add()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search; what it finds depends on the model, so its recall is what is held against SQL."""
    return _shown(_found_by_codes(spark, sf_dir)[0])


_WANTED = "(" + _CORPUS + "SELECT '{kind}' AS kind, count(*) AS wanted, true AS reached FROM ranked WHERE rank <= 10)"


@R.add(_WANTED.format(kind="all rows", applies=_LABEL, where="true") + " UNION ALL " + _WANTED.format(kind="rows of a class", applies=_LABEL, where="list_contains(applies_to, class)"))
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many true neighbours there are, and whether the approximate index finds nine in ten of them: without a filter, and with one inside the lists."""
    out = None
    for kind, classes in (("all rows", None), ("rows of a class", lambda c: F.array(c))):
        row = ann.recall(*_found_by_codes(spark, sf_dir, classes)).select(F.lit(kind).alias("kind"), "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))
        out = row if out is None else out.unionByName(row)
    return out


@R.add("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm2 FROM embeddings")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


@R.add("SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 4) OR embedding[1]::DOUBLE > 0.15 GROUP BY label")
def entity_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    applies = F.when(_no_class(), F.array().cast("array<string>")).otherwise(F.array(F.col("label").cast("string")))
    return table.filter(entity_filter(applies, ["1", "4"])).groupBy("label").agg(F.count("*").alias("n"))


@R.add("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)), 4) AS mark FROM embeddings""")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written to files and read back in ranges of bytes: their row numbers are their places in order of id."""
    spark.dataSource.register(VectorFiles)
    path = f"{shared_dir(spark)}/folioflow-vectors-{uuid.uuid4().hex}"
    in_ranges(read_table(spark, sf_dir, "embeddings"), "vec_id").write.format("vectors").mode("overwrite").option("rows", 300).save(path)
    back = spark.read.format("vectors").option("rows", 70).load(path)
    mark = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return back.select("row", F.round(mark, 4).alias("mark"))


@R.add("""SELECT count(*) FILTER (WHERE v.doc_id IS NULL) AS chunks_alone, count(*) FILTER (WHERE d.doc_id IS NULL) AS vectors_alone
FROM documents d FULL JOIN (SELECT vec_id AS doc_id FROM embeddings) v ON d.doc_id = v.doc_id""")
def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return search.pairing_mismatches(docs, vectors, "doc_id")
