"""Registry of named queries and their ANSI SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures, duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "", ctes: str = ""):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``.

    ``uses`` lists the derived tables the SQL twin reads; ``ctes`` adds further WITH entries; ``sql`` is the final
    SELECT. Without ``sql`` the query has no twin and is covered by the tests instead.
    """

    def wrap(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            parts = [p for p in (duck_ctes(*uses.split()) if uses else "", ctes.strip().rstrip(",")) if p]
            recursive = "RECURSIVE " if "recursive" in ctes.lower() else ""
            ORACLES[name] = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
        return fn

    return wrap
