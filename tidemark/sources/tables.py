"""Reading and writing tables.

Finished metric tables are handed from one step to the next as parquet split
by month, so that a later step reads only the months it asks for.  CSV is
there for exchange with other tools.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.session import scratch_table
from tidemark.sources.schemas import SCHEMAS

BOM = "\ufeff"
MOST_BUCKETS = 10_000


def list_files(spark: SparkSession, root: str, suffix: str = ".csv") -> DataFrame:
    """Path and size of the files under ``root`` with a suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length")


def read_texts(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """All columns of a headed CSV file, or of all ``.csv`` files of a folder, as texts; ``exact`` keeps outer spaces."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False)
    reader = reader.option("pathGlobFilter", "*.csv").option("escape", '"' if exact else "\\")
    texts = reader.csv(path)
    return texts.toDF(*[c.removeprefix(BOM) for c in texts.columns])


def wanted_fields(columns: list[str], schema: str, path: str) -> list[StructField]:
    """The fields of a schema, all of which must be among the columns found."""
    wanted = list(StructType.fromDDL(schema))
    missing = [f.name for f in wanted if f.name not in columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return wanted


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of a schema from a headed CSV file, or from all ``.csv`` files of a folder.

    Columns are found by the names of the header, in any order and among
    others; a missing one raises here, a text that its type cannot hold raises
    when it is read.  Files of a folder must have the same header.
    """
    texts = read_texts(spark, path)
    # An ANSI cast also where the session is set otherwise: null only for null.
    return texts.select(*[strict(f).alias(f.name) for f in wanted_fields(texts.columns, schema, path)])


def strict(field: StructField) -> Column:
    """The value of a text column with the name of a field; a text that the type cannot hold raises."""
    text = F.col(f"`{field.name}`")
    value = text.try_cast(field.dataType)
    bad = F.raise_error(F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text))
    return F.when(text.isNotNull() & value.isNull(), bad.cast(field.dataType)).otherwise(value)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of CSV files, or of CSV folders, with its declared schema."""
    return read_csv(spark, os.path.join(root, f"{name}.csv"), SCHEMAS[name])


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Headed CSV, by default marked as UTF-8 for spreadsheet programs."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_mart(df: DataFrame, path: str, month: str | None = None) -> None:
    """Parquet, one folder per value of the ``month`` column where there is one."""
    if month is None:
        df.write.mode("overwrite").parquet(path)
        return
    # Gathers a month into few files, and splits a month that is too large for one.
    df.hint("rebalance", month).write.mode("overwrite").partitionBy(month).parquet(path)


def buckets_for(df: DataFrame, megabytes: int = 128) -> int:
    """Buckets of about so many megabytes, by Spark's estimate of the table's size.

    At least as many as a shuffle has partitions: Spark shuffles a table in fewer buckets again.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // (megabytes << 20)), MOST_BUCKETS))


def write_by_user(
    spark: SparkSession, df: DataFrame, path: str, buckets: int | None = None, user: str = "user_id"
) -> DataFrame:
    """A bucketed table of ``df`` under ``path``: later groupings and joins on the user need no shuffle of it.

    For tables with few rows per user.  A bucket is read by one task, so a
    table of raw events, where one user may own a large part, does not belong here.
    """
    table = scratch_table(os.path.basename(path).replace("-", "_"))
    buckets = buckets or buckets_for(df)
    # Partitioned like the buckets, so that each task writes one file.
    placed = df.repartition(buckets, user)
    placed.write.bucketBy(buckets, user).sortBy(user).option("path", path).saveAsTable(table)
    return spark.table(table)


def read_mart(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A mart with its declared column types; a month key stays text."""
    return spark.read.schema(schema).parquet(path)
