"""The tables of registered queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Formulas over grids of their own, which read no stored table; tested beside their SQL, but no queries.
FORMULAS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FORMULA_SQL: dict[str, str] = {}


def query(twin: str | None = None, queries: dict = QUERIES, sql: dict = SQL):
    """Register a function (spark, sf_dir) under its name, with its SQL if there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        queries[f.__name__] = f
        if twin:
            sql[f.__name__] = twin
        return f

    return register


def formula(twin: str | None = None):
    return query(twin, FORMULAS, FORMULA_SQL)
