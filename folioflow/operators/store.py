"""Keeping tables: upserts, partial updates, what is still to do, category views, files, collections and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import safe_name
from folioflow.plans.materialize import spill
from folioflow.schemas import LOG_DDL, PAYLOAD, migrate


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; partly ranked before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """``table`` after ``delta``: a matched row takes every column that ``delta`` has, nulls too, and keeps the others; new keys are added.

    ``delta`` has one row per key; a table without row-level updates is rewritten from this.
    """
    given = [c for c in delta.columns if c != key]
    new = delta.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in given])
    both = table.join(new, table[key] == new["_key"], "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    return both.select(F.coalesce(key, "_key").alias(key), *[pick(c).alias(c) for c in table.columns if c != key])


def unfetched(table: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key isn't among those done."""
    return table.join(done.select(key), key, "left_anti")


def categories(docs: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """``docs`` once under every category it belongs to: (kind, category). ``kinds`` maps a kind to an array of names."""
    parts = [_labelled(kind, names) for kind, names in kinds.items()]
    return docs.withColumn("_c", F.explode(F.concat(*parts))).select("*", F.col("_c.kind").alias("kind"), F.col("_c.category").alias("category")).drop("_c")


def _labelled(kind: str, names: Column) -> Column:
    clean = F.array_compact(F.coalesce(names, F.array().cast("array<string>")))
    return F.transform(clean, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("category")))


def circular_categories(docs: DataFrame) -> DataFrame:
    """Under every class it binds and its department."""
    return categories(docs, {"entity": F.col("applies_to"), "department": F.array("department")})


def write_categories(docs: DataFrame, path: str) -> None:
    """One folder per kind and category, named safely."""
    circular_categories(docs).withColumn("category", safe_name(F.col("category"))).write.mode("overwrite").partitionBy("kind", "category").parquet(path)


def dated(docs: DataFrame) -> DataFrame:
    """``docs`` with the year and month of their date, or undated/00."""
    day = F.col("issue_date")
    return docs.withColumns({"year": F.coalesce(F.substring(day, 1, 4), F.lit("undated")), "month": F.coalesce(F.substring(day, 6, 2), F.lit("00"))})


def write_dated(docs: DataFrame, path: str) -> None:
    dated(docs).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def csv_index(docs: DataFrame) -> DataFrame:
    """The flat index, newest first, undated last; classes joined by semicolons."""
    return docs.select(
        "number", "issue_date", "department", F.array_join(F.coalesce("applies_to", F.array().cast("array<string>")), "; ").alias("applies_to"), "meant_for", "subject", F.col("local_path").alias("path")
    ).orderBy(F.desc_nulls_last("issue_date"), "number")


def write_csv(docs: DataFrame, path: str) -> None:
    csv_index(docs).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def append_log(records: DataFrame, path: str) -> None:
    """Add records, successes and errors, to a log that is never overwritten."""
    migrate(records, LOG_DDL).write.mode("append").parquet(path)


def build_collection(chunks: DataFrame, vectors: DataFrame, path: str) -> int:
    """Rewrite the search collection: payload and vector per chunk, laid out by ranges of department and chunk, so that a department of any size is dealt to many tasks.

    The count must equal the chunks' or it is an error.
    """
    # merged: by the size of the compressed files they come from, Spark would take texts and vectors for small and broadcast them through the driver
    points = spill(chunks.select("chunk_id", *PAYLOAD).hint("merge").join(vectors.select("chunk_id", "embedding"), "chunk_id"), "points")  # ranges are found in one pass and cut in another
    points.repartitionByRange("department", "chunk_id").sortWithinPartitions("department", "issue_date").write.mode("overwrite").parquet(path)
    want, got = chunks.count(), chunks.sparkSession.read.parquet(path).count()
    if want != got:
        raise ValueError(f"expected {want} points, found {got}")
    return got
