"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from folioflow.plans import documents, relational, similarity, tables
from folioflow.plans.registry import Query


def queries() -> dict[str, Query]:
    """Every query of the library by name."""
    return similarity.R.queries | documents.R.queries | relational.R.queries | tables.R.queries


def oracle_sql() -> dict[str, str]:
    return similarity.R.sql | documents.R.sql | relational.R.sql | tables.R.sql
