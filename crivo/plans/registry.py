"""The registered queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with SQL when SQL can state the result."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums whose last digits depend on the order of addition."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col("`" + c + "`") for c in df.columns])
