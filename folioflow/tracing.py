"""Spans of a pipeline run. Without a sink they cost nothing; a failing sink never breaks the pipeline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SPANS_DDL = "name string, kind string, started double, seconds double, error string, note string"
_sink: Callable[[dict], None] | None = None


def configure(sink: Callable[[dict], None] | None) -> None:
    global _sink
    _sink = sink


def enabled() -> bool:
    return _sink is not None


@contextmanager
def observe(name: str, kind: str = "span", spark: SparkSession | None = None) -> Iterator[dict]:
    """A span; Spark jobs inside carry its name as their description. Put a ``note`` into what is yielded to keep it."""
    if spark is not None:
        spark.sparkContext.setJobDescription(name)
    span = {"name": name, "kind": kind, "started": time.time(), "error": None, "note": None}
    try:
        yield span
    except BaseException as e:
        span["error"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        span["seconds"] = time.time() - span["started"]
        if spark is not None:
            spark.sparkContext.setJobDescription(None)
        if _sink is not None:
            try:
                _sink(dict(span))
            except Exception:  # tracing must not fail the work it watches
                pass


def to_table(spark: SparkSession, spans: list[dict], path: str) -> None:
    """Append collected spans to a table."""
    rows = [tuple(s.get(k) for k in ("name", "kind", "started", "seconds", "error", "note")) for s in spans]
    spark.createDataFrame(rows, SPANS_DDL).write.mode("append").parquet(path)
