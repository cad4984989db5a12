"""Joins in which null is a key like any other."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal ``keys``, nulls matching nulls; the keys come once, from ``a``.  Inner, left, semi and anti joins."""
    other = b.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    same = reduce(and_, (a[k].eqNullSafe(other[f"_key_{i}"]) for i, k in enumerate(keys)))
    return a.join(other, same, how).drop(*(f"_key_{i}" for i in range(len(keys))))
