"""Registration of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floats to ``places`` decimals: engines sum in different orders.

    As DuckDB does it: the double times a power of ten goes to the nearest whole number, halves away from zero.
    """
    from pyspark.sql import functions as F

    def near(c):
        v = F.col(c) * 10.0**places
        low = F.floor(F.abs(v)).cast("double")
        whole = F.signum(v) * (low + F.when(F.abs(v) - low >= 0.5, 1.0).otherwise(0.0))
        # whole numbers and what is beyond them stay
        return F.when(F.abs(v) < 2.0**52, whole / 10.0**places).otherwise(F.col(c))

    to = {"double": near, "float": lambda c: F.round(F.col(c), places)}
    return df.select(*((to[t](c) + 0.0).alias(c) if t in to else F.col(c) for c, t in df.dtypes))
