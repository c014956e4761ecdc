"""A registry of queries and their DuckDB twins. A query begins with bounded batches for Python workers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioflow.session import bounded

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with the SQL that gives the same rows."""

        def register(f: Query) -> Query:
            @wraps(f)
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(bounded(spark), sf_dir)

            self.queries[f.__name__] = query
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
