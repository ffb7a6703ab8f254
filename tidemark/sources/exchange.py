"""CSV tables that carry their schema, so that any table is read back row for row.

The schema lies beside the table, in ``<name>.schema``.  Texts are quoted and all
else is not, so a key such as ``2022-05`` stays text in a spreadsheet too.  An empty
cell is null; an empty text, a line break and a backslash are written with a
backslash, so that one line is one row and a large table can be read by many tasks.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructField, StructType

from tidemark.sources.tables import BOM, read_texts, strict

#: What is written for a backslash, a line feed, a carriage return and an empty text.
BACKSLASH, LINE_FEED, RETURN, EMPTY = "\\\\", "\\n", "\\r", "\\e"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _cell(field: StructField) -> Column:
    """A cell as it stands in the file.  The cast to text is exact, which the CSV writer's own formats are not."""
    text = F.col(f"`{field.name}`").cast("string")
    if not isinstance(field.dataType, StringType):
        return text
    text = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    text = F.replace(F.replace(text, F.lit("\n"), F.lit(LINE_FEED)), F.lit("\r"), F.lit(RETURN))
    return _quoted(F.when(text == "", EMPTY).otherwise(text))


def _plain(c: str) -> Column:
    """The text behind a cell: between two backslashes in a row there is no other pair, so those are taken first."""

    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit(LINE_FEED), F.lit("\n")), F.lit(RETURN), F.lit("\r"))
        return F.replace(x, F.lit(EMPTY), F.lit(""))

    cell = F.col(f"`{c}`")
    parts = F.transform(F.split(cell, r"\\\\"), part)
    return F.when(F.contains(cell, F.lit("\\")), F.array_join(parts, "\\")).otherwise(cell)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """``<name>.csv``, marked as UTF-8 for spreadsheet programs, and ``<name>.schema`` under ``root``."""
    flat = [f.name for f in df.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, BinaryType)]
    if flat != df.columns:
        raise ValueError(f"CSV holds no {', '.join(set(df.columns) - set(flat))}")
    null = '""' if len(flat) == 1 else ""  # a line of nothing would be no row
    line = F.concat_ws(",", *(F.coalesce(_cell(f), F.lit(null)) for f in df.schema))
    header = BOM + ",".join('"' + c.replace('"', '""') + '"' for c in flat)
    # The lines are finished: the writer finds nothing to separate or to quote in them.
    writer = df.select(line.alias(header)).write.option("header", True).option("encoding", "UTF-8")
    writer = writer.option("sep", "\u0001").option("quote", "").option("escape", "\u0000")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(os.path.join(root, f"{name}.csv"))
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string")
    schema.coalesce(1).write.text(os.path.join(root, f"{name}.schema"))


def read_schema(spark: SparkSession, root: str, name: str) -> StructType:
    """The schema that was written beside a table: one short row."""
    line = spark.read.text(os.path.join(root, f"{name}.schema")).first()
    return StructType.fromJson(json.loads(line.value))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of :func:`write_table` with the columns and types it had; a cell that does not fit raises."""
    schema = read_schema(spark, root, name)
    texts = read_texts(spark, os.path.join(root, f"{name}.csv"), exact=True)
    columns = [_plain(f.name) if isinstance(f.dataType, StringType) else strict(f) for f in schema]
    return texts.select(*[c.alias(f.name) for c, f in zip(columns, schema)])
