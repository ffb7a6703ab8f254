"""Profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, non-null count and row count, from a single pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.col(c).alias("non_null_cnt"),
            F.col("_rows").alias("row_cnt"),
        )
        for c, t in df.dtypes
    ]
    return counts.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows per non-null value, the most frequent first."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), c)
