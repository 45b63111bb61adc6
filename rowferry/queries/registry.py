"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..operators.union import separate_union_inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _prepared(run: Query) -> Query:
    @wraps(run)
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        separate_union_inputs(spark)
        return run(spark, folder)

    return prepared


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = _prepared(run)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
