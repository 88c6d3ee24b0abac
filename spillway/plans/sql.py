"""How queries are registered, and pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from ..fixtures import with_tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = "time_bucket(INTERVAL 1 day, ts)"
HOUR = "time_bucket(INTERVAL 1 hour, ts)"


def query(sql: str | None = None, *tables: str) -> Callable:
    """Registers a function under its name, with the DuckDB SQL for its rows over the named fixture tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _counts(with_tables(sql.strip(), *tables) if tables else sql)
        return f

    return add


def _counts(sql: str) -> str:
    """count_if(x) as a count of 64 bits."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def codes_sql(column: str, names: dict[int, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'UNKNOWN' END"
