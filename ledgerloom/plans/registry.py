"""Where queries and their SQL register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL of the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def pick(key: Column, choices: list, kind: str = "string") -> Column:
    """The choice that the rest of a key gives: choices dealt over the rows of a table."""
    return F.get(F.array(*(F.lit(c).cast(kind) for c in choices)), F.pmod(key, F.lit(len(choices))).cast("int"))


def pick_sql(key: str, choices: list, kind: str = "VARCHAR") -> str:
    """The same in SQL."""
    lit = lambda v: "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"CAST([{', '.join(map(lit, choices))}] AS {kind}[])[CAST({key} AS BIGINT) % {len(choices)} + 1]"


def values(rows: list[tuple], columns: str) -> str:
    """SQL for literal rows; columns is "name TYPE, ..."."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    named = [c.split(" ", 1) for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in named)} FROM (VALUES {body}) t({', '.join(n for n, _ in named)})"
