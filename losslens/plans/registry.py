"""A registry of queries: name -> callable(spark, sf_dir), and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from losslens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, *tables: str):
    """Register a function of DataFrames (its named tables, in order) as a query; ``covers`` names the operators of the survey."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*(table(spark, sf_dir, t) for t in tables))

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        if build.__name__ in QUERIES:
            raise ValueError(f"{build.__name__} is registered already")
        QUERIES[build.__name__] = run
        COVERS[build.__name__] = covers
        if sql:
            SQL[build.__name__] = sql
        return build

    return register
