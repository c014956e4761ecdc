"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing by source, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again for the next one. All but the last return the columns of documents. Stages inherit the rules of their operators
for nulls, empty and long texts, ties, repeated rows, empty tables and extra columns.

- language: documents that language ID rejects go, texts without a letter among them.
- exact: of equal texts the one with the largest id stays.
- near: one document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one with the least id.
- mix: sources are mixed to their target weights; a document that is taken n times is n rows.
- tokens: texts become the ids of a SentencePiece vocabulary; decoding them gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import language_id, sentencepieces
from folioflow.llm.exact_dedup import exact_dedup
from folioflow.llm.minhash import near_dedup
from folioflow.llm.mixing import mix_sources
from folioflow.plans.materialize import spill
from folioflow.session import bounded
from folioflow.sources.tables import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return language_id.accepted(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    coded = sentencepieces.encode_and_decode(docs)
    return coded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: The models of the first and last stage can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; between stages the rows lie in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
