"""Registered queries over the driver tables and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .recommend import Tables, recommend, tables

Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan over :func:`tables` under ``name``, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend(spark, sf_dir)


def _load() -> None:
    from . import data_queries, eval_queries, model_queries, retrieval_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
