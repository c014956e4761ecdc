"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, through Spark's reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
