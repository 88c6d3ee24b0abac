"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import decode_queries, lookup_queries, sql, stream_queries, traffic_queries  # noqa: F401  (the modules register their queries)

FLAGSHIP = "querypop_top"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(sql.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE_SQL)
