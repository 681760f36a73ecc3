"""All registered queries of the decision-log engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("source_queries", "scalar_queries", "check_queries", "split_queries", "history_queries", "policy_queries", "metric_queries", "compare_queries", "learn_queries", "stream_queries")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say it."""

    def put(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


def _load() -> None:
    for module in MODULES:
        import_module(f"quillog.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["flagship_policy_panel"](spark, sf_dir)


FLAGSHIP = flagship
