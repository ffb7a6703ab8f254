"""Facts kept by month, loaded in batches, and marts that follow them month by month.

A load is stored under its own name within each month it touches, so that loading it
again after a failure replaces what it stored and doubles nothing.  A mart is
refreshed for the months that got new rows; the files of all other months stay.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.predicates import month_between
from tidemark.functions.timekeys import month_key

#: The columns that name a fact's folder.
MONTH, LOAD = "month", "load"
#: Before every month; a filter that keeps all months, which Spark needs to see before it prunes by a table of months.
EARLIEST = "0000-00"


def _overwrite_months(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes the folders that ``df`` has rows for and leaves the others; a month too large for one file is split."""
    gathered = df.hint("rebalance", *partitions)
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def store_load(rows: DataFrame, path: str, date: str, load: str) -> None:
    """Adds rows to the facts under ``path`` as one load; rows without a date lie under a null month.

    A load that is stored again must hold the same months.
    """
    dated = rows.withColumns({MONTH: month_key(date), LOAD: F.lit(load)})
    _overwrite_months(dated, path, MONTH, LOAD)


def facts_schema(schema: StructType) -> StructType:
    """The columns of stored facts, from those of the rows."""
    return StructType([*schema.fields]).add(MONTH, "string").add(LOAD, "string")


def read_facts(
    spark: SparkSession, path: str, schema: StructType, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Facts with ``month`` and ``load``; with a range of months (``yyyy-MM``) only the folders of these are read."""
    facts = spark.read.schema(facts_schema(schema)).parquet(path)
    return facts if first is None and last is None else facts.filter(month_between(MONTH, first, last))


def months_of(rows: DataFrame, date: str) -> DataFrame:
    """The months that rows fall into, a row each."""
    return rows.filter(F.col(date).isNotNull()).select(month_key(date).alias(MONTH)).distinct()


def facts_in(facts: DataFrame, months: DataFrame) -> DataFrame:
    """The facts of the months of a table.  Spark reads that table first and then only the folders it names."""
    named = months.filter(F.col(MONTH) >= EARLIEST)
    return facts.join(named, MONTH, "left_semi")


def refresh_mart(facts: DataFrame, months: DataFrame, mart: str, make: Callable[[DataFrame], DataFrame], month: str) -> None:
    """Makes the mart anew for the months of a table, from all their facts, late ones included.

    ``make`` turns facts into the mart's rows; ``month`` is its column of month
    keys.  A month of the mart must depend on the facts of that month only.
    """
    _overwrite_months(make(facts_in(facts, months)), mart, month)


def load_and_refresh(
    spark: SparkSession,
    rows: DataFrame,
    root: str,
    load: str,
    date: str,
    make: Callable[[DataFrame], DataFrame],
    month: str,
) -> str:
    """Stores a load under ``root`` and refreshes the mart beside it for the months of the load; gives the mart's path."""
    facts, mart = os.path.join(root, "facts"), os.path.join(root, "mart")
    store_load(rows, facts, date, load)
    stored = read_facts(spark, facts, rows.schema)
    # The months of what is stored now: the load itself may be costly, and is not computed again for them.
    touched = stored.filter(F.col(LOAD) == load).select(MONTH).distinct()
    refresh_mart(stored, touched, mart, make, month)
    return mart
