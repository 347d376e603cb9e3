"""Where queries are registered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..entities import entity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _closing(sql: str, opening: int) -> int:
    depth = 0
    for i in range(opening, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if depth == 0:
            return i
    raise ValueError(sql[opening:])


def expanded(sql: str) -> str:
    """Write round(x, 2) so that the checking engine rounds as :func:`revsight.functions.scores.round2` does."""
    at = 0
    while (k := sql.find("round(", at)) >= 0:
        end = _closing(sql, k + 5)
        inner = sql[k + 6 : end]
        if inner.endswith(", 2") and "AS DECIMAL(30, 8))" not in inner[-25:]:
            inner = expanded(inner[:-3])
            new = f"CAST(round(CAST({inner} AS DECIMAL(30, 8)), 2) AS DOUBLE)"
            sql, at = sql[:k] + new + sql[end + 1 :], k + len(new)
        else:
            at = k + 6
    return sql


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function below under ``name``; ``sql``: what the checking engine runs, None where SQL can't say it."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = expanded(sql)
        return f

    return keep


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [entity(spark, sf_dir, n) for n in names]
