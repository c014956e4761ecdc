"""Sessions with the settings the engine relies on; a session that exists keeps its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def session(name: str = "folioflow", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "4m"


def bounded(spark: SparkSession) -> SparkSession:
    """``spark`` with batches of at most BATCH bytes for Python workers, in place of Spark's default of 64 MB; another setting is kept.

    Called where queries and pipeline stages begin, never by operators: it bounds memory and changes no result.
    """
    if spark.conf.get(ARROW_BYTES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(ARROW_BYTES, BATCH)
    return spark
