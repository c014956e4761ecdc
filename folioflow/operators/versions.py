"""Tables of whole versions: a commit log beside the data decides what readers see.

A table is a folder. Writers put data into new folders under ``data`` that nobody reads yet; a version comes to be when its manifest, the list of the folders that make up the table, is
renamed to ``_log/<number>.json``, which fails if that version exists. So of two writers one wins and the other starts again from the winner's version, a reader sees a version whole or not at
all, whatever fails half-way, and every version that hasn't expired can be read. Rows lie in buckets by key: a merge rewrites only the buckets it touches, the manifest takes the others over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.store import latest, upsert
from folioflow.plans.materialize import spill

BUCKETS = 64
RETRIES = 5
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _files(spark: SparkSession, path: str):
    """(what works on files there, the path) for the file system of a path."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _log(table: str, version: int) -> str:
    return f"{table}/_log/{version:0{DIGITS}d}.json"


def version_numbers(spark: SparkSession, table: str) -> list[int]:
    fs, log = _files(spark, f"{table}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict | None:
    """The manifest of a version, of the last one by default; null where there is none."""
    if version is None:
        version = max(version_numbers(spark, table), default=None)
    if version is None:
        return None
    fs, path = _files(spark, _log(table, version))
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, table: str, version: int, parts: dict[str, str], note: dict | None = None) -> None:
    """Make ``parts`` (bucket to folder, below the table) the version ``version``; a Conflict if there is one."""
    jvm = spark.sparkContext._jvm
    fs, aside = _files(spark, f"{table}/_log/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"version": version, "parts": parts, "note": note or {}}, sort_keys=True).encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(_log(table, version)), rename)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(_log(table, version))):
            raise Conflict(f"version {version} of {table} exists") from e
        raise


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """A version of the table, the last one by default; null where there is none or it has no rows."""
    found = manifest(spark, table, version)
    return spark.read.parquet(*[f"{table}/{p}" for p in found["parts"].values()]) if found and found["parts"] else None


def merge(delta: DataFrame, table: str, key: str, newest: str, buckets: int = BUCKETS, note: dict | None = None) -> int:
    """Upsert ``delta`` and commit a new version, whose number is returned. Of rows with one key the one with the largest ``newest`` stays, whenever it arrives."""

    def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
        stored = old.select(F.col(key).alias("_key"), F.col(newest).alias("_newest"))
        in_time = F.col("_newest").isNull() | (F.col(newest) >= F.col("_newest"))
        return upsert(old, new.join(stored, F.col(key) == F.col("_key"), "left").filter(in_time).drop("_key", "_newest"), key)

    return change(latest(delta, key, [F.desc(newest)]), table, key, upserted, buckets, note)


def change(delta: DataFrame, table: str, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS, note: dict | None = None) -> int:
    """Commit a new version, whose number is returned: ``combine`` makes the touched buckets from their old rows and those of ``delta``.

    A writer that comes second starts again from the version of the first.
    """
    spark = delta.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    new = spill(delta.withColumn("bucket", bucket), "delta")
    touched = [str(r["bucket"]) for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    for _ in range(RETRIES):
        base = manifest(spark, table) or {"version": 0, "parts": {}}
        rows, old_parts = new, [f"{table}/{base['parts'][b]}" for b in touched if b in base["parts"]]
        if old_parts:
            rows = combine(spark.read.parquet(*old_parts), new.drop("bucket")).withColumn("bucket", bucket)
        version = base["version"] + 1
        folder = f"data/v={version:0{DIGITS}d}-{uuid.uuid4().hex}"
        if touched:
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/{folder}")
        try:
            commit(spark, table, version, base["parts"] | {b: f"{folder}/bucket={b}" for b in touched}, note)
            return version
        except Conflict:
            continue
    raise Conflict(f"{RETRIES} other writers were faster at {table}")


def expire(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Remove all versions but the last ``keep``, and the folders that only they, or writers that lost or failed, have written. What is being written now stays."""
    numbers = version_numbers(spark, table)
    fs, data = _files(spark, f"{table}/data")
    if not numbers or not fs.exists(data):
        return
    kept = [manifest(spark, table, v) for v in numbers[-keep:]]
    used = {p.rsplit("/", 1)[0].removeprefix("data/") for m in kept for p in m["parts"].values()} | {""}
    for v in numbers[:-keep]:
        fs.delete(_files(spark, _log(table, v))[1], False)
    for status in fs.listStatus(data):
        name = status.getPath().getName()
        if name not in used and int(name[2 : 2 + DIGITS]) <= numbers[-1]:
            fs.delete(status.getPath(), True)
        elif name in used:
            for part in fs.listStatus(status.getPath()):
                if not any(f"data/{name}/{part.getPath().getName()}" in m["parts"].values() for m in kept):
                    fs.delete(part.getPath(), True)
