"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _decimals_as_doubles(df: DataFrame) -> DataFrame:
    """Money stays decimal until the end; results are compared as doubles."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in money}) if money else df


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function name together with its SQL."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _decimals_as_doubles(fn(spark, sf_dir))

        QUERIES[fn.__name__] = run
        ORACLES[fn.__name__] = sql
        return fn

    return register
