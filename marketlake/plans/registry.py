"""Named queries and, where SQL can express them, the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

__all__ = ["ORACLES", "QUERIES", "big", "query", "rnd", "rounded"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rnd(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def rounded(digits: int, *names: str) -> list[Column]:
    return [rnd(n, digits) for n in names]


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)
