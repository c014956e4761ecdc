"""Incremental ingestion: new files are parsed and upserted once, whatever restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioflow.operators import versions


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, newest: str, buckets: int = versions.BUCKETS, keep: int = 2) -> StreamingQuery:
    """Upsert each micro-batch into a versioned table, see ``versions.merge``: readers see whole batches only.

    The manifest names the stream's last batch: one that runs again after a failure is not applied twice.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = (versions.manifest(spark, table) or {"note": {}})["note"].get(checkpoint, -1)
        if batch_id > last:
            versions.merge(batch, table, key, newest, buckets, {checkpoint: batch_id})
            versions.expire(spark, table, keep)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as of its last whole batch; null where there is none."""
    return versions.read(spark, table)


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a repeated row is dropped if it comes within ``late`` of the first, and a row later than the watermark is dropped anyhow.

    State is a key for each row of the last ``late``, not of all time.
    """
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to a folder of files; each row once, whatever restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values per window and kind; rows later than the watermark are dropped from streams."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind)
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
    )
