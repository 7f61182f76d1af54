"""A register of named queries, each with the SQL it is held against, if SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinewood.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(*tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register a function of the named tables as a query of (spark, folder)."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(*(table(spark, folder, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return wrap


def folder_query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, folder) itself: queries that keep tables need to know where theirs come from."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap


#: SQL of the views that several queries stand on.
FOLD = "trim(replace(upper(strip_accents({})),'ẞ','SS'))"
LINES = "lines AS (SELECT doc_id, source, CAST(pos - 1 AS BIGINT) AS pos, parts[pos] AS line FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"
