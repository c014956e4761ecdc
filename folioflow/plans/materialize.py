"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs a re-read, not a re-computation, and a plan that uses
the table twice reads it twice instead of computing it twice.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a temporary one is set, if driver and executors are one process; else it is an error."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
