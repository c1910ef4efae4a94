"""Registration of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may name any derived view and is completed with its definition."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: rnd(n, digits).alias(n) for n in names})


def rnd(c: Column | str, digits: int = 9) -> Column:
    value = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return value + F.lit(0.0)


def off_tie(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Round after a tiny offset, for means that are exact decimals and would sit on a rounding tie."""
    return df.withColumns({n: rnd(F.col(n) + F.lit(3.7e-12), digits).alias(n) for n in names})
