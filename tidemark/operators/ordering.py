"""Sorts of finished metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_position(c: str, categories: Sequence[str]) -> Column:
    """Place of a value in a given list; values outside the list come after it."""
    place = F.array_position(F.array(*[F.lit(v) for v in categories]), F.col(c))
    return F.when(place > 0, place).otherwise(len(categories) + 1)


def order_by_category(df: DataFrame, c: str, categories: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(category_position(c, categories), c, *then)


def head(df: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """First ``n`` rows in the order of ``keys``; runs as a per-task top-n, not a full sort."""
    return df.orderBy(*keys).limit(n)
