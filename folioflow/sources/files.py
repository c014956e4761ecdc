"""Files as tables: cached bodies, JSON lines, PDFs, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.schemas import CHUNKS_DDL, LOG_DDL, struct

PDF_MAGIC = b"%PDF-"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(body_path, rbi_id, html) of cached bodies; the id is the last number of the file name."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("body_path"), F.col("value").alias("html"))
    return df.withColumn("rbi_id", F.expr(r"try_cast(regexp_extract(body_path, '(\\d+)\\.html$', 1) AS bigint)")).select("body_path", "rbi_id", "html")


def with_bodies(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents with their body; those whose file is missing are dropped."""
    return docs.filter(F.col("body_path").isNotNull()).join(bodies.select("body_path", "html"), "body_path")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(CHUNKS_DDL)).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(LOG_DDL)).parquet(path)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files; answers of another kind that were saved under such a name are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return df.filter(is_pdf(F.col("content")))


def is_pdf(content):
    return F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """The pruned docs table for chunking, newest first."""
    cols = ["key", "rbi_id", "number", "ref_code", "issue_date", "department", "applies_to", "meant_for", "subject", "source_url", "body_path"]
    return spark.read.parquet(path).filter(F.col("body_path").isNotNull()).select(*cols).orderBy(F.desc_nulls_last("issue_date"), "key")
