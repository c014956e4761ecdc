"""Summaries kept up to date by what is new: counts of equal values, from which totals and the exact upper median follow.

The state of a summary is a versioned table of (group, value, n). Counts add up, so a batch of new rows is counted by itself and added to the buckets it touches; what was counted before is not
read again but for those counts. A report is made of the counts alone: as many rows as there are different values in a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.operators import versions

STATE = "group string, value long, n long"


def add(rows: DataFrame, table: str, group: str, value: str, buckets: int = versions.BUCKETS, note: dict | None = None) -> int:
    """Count the rows of a batch into the summary in the folder ``table``; the number of its new version. Null values aren't counted, a null group is a group."""
    delta = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("group"), F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    delta = delta.withColumn("key", F.xxhash64("group", "value"))

    def added(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.select(*new.columns).unionByName(new).groupBy("group", "value", "key").agg(F.sum("n").alias("n"))

    return versions.change(delta, table, "key", added, buckets, note)


def report(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """(group, n, total, least, most, median) of a summary; the median is the upper one."""
    state = versions.read(spark, table, version)
    if state is None:
        state = spark.createDataFrame([], STATE)
    upto = W.partitionBy("group").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = state.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("group")))
    return counted.groupBy("group").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("value"))).alias("median"),
    )
