"""Queries by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """All registered queries."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have one."""
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunks, deduplication and the summary of the corpus."""
    return _QUERIES["agg13_corpus_summary"](spark, sf_dir)


from . import corpus, evidence, flows, grounding, logs, pages, records, search, tables  # noqa: E402, F401  (their queries register themselves)
