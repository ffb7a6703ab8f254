"""Loading CSV files of which some rows do not parse: these go to a table of their own.

A record is a line.  Blank lines are no rows.  What is loaded and what is rejected
add up to the lines behind the headers.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.schemas import SCHEMAS
from tidemark.sources.tables import BOM, read_texts, wanted_fields

#: The column named for a record with too few or too many cells, and for a header within a file.
ANY_COLUMN = "*"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, block, at): the lines of ``.csv`` files; ``at`` rises by one from line to line of a block of a file."""
    texts = spark.read.option("pathGlobFilter", "*.csv").text(path)
    return texts.select(
        F.ltrim(F.col("value"), F.lit(BOM)).alias("record"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _first_lines(lines: DataFrame) -> DataFrame:
    """(f, b, first, before): where a block's lines begin, and the number of lines before it in its file; a row per block."""
    blocks = lines.groupBy(F.col("file").alias("f"), F.col("block").alias("b"))
    blocks = blocks.agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("f", "b", "first", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def read_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a headed CSV file, or of all ``.csv`` files of a folder, which must have the same header.

    Rows have the columns of the schema, found by name.  A reject has the
    ``file``, the ``line`` in it, counted from 1, the first ``column`` of the
    schema that does not parse, its text as ``value``, and the whole ``record``.
    """
    names = read_texts(spark, path).columns
    fields = wanted_fields(names, schema, path)
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "ragged"}
    lines = _lines(spark, path)
    parsed = F.from_csv("record", f"{cells}, ragged string", options)
    read = lines.filter(F.trim("record") != "").withColumn("cells", parsed)
    text = {f.name: F.col(f"cells.c{names.index(f.name)}") for f in fields}
    value = {f.name: text[f.name].try_cast(f.dataType) for f in fields}
    # A file's first line has the names; it stands out as a record whose cells are the names of their columns.
    is_header = F.lit(True)
    for i, name in enumerate(names):
        is_header = is_header & F.coalesce(F.col(f"cells.c{i}") == name, F.lit(False))
    fault = F.when(is_header | F.col("cells.ragged").isNotNull(), ANY_COLUMN)
    shown = F.when(is_header | F.col("cells.ragged").isNotNull(), F.col("record"))
    for f in fields:
        bad = text[f.name].isNotNull() & value[f.name].isNull()
        fault, shown = fault.when(bad, f.name), shown.when(bad, text[f.name])
    judged = read.withColumns({"column": fault, "value": shown, "is_header": is_header})
    rows = judged.filter(F.col("column").isNull()).select(*[value[f.name].alias(f.name) for f in fields])
    return rows, _numbered(judged.filter(F.col("column").isNotNull()), _first_lines(lines))


def _numbered(faults: DataFrame, blocks: DataFrame) -> DataFrame:
    """Faults with their line; the headers at the beginning of the files are none."""
    line: Column = F.col("before") + F.col("at") - F.col("first") + 1
    found = faults.join(blocks, (faults.file == blocks.f) & (faults.block == blocks.b)).withColumn("line", line)
    return found.filter(~(F.col("is_header") & (F.col("line") == 1))).select("file", "line", "column", "value", "record")


def load_table_with_rejects(spark: SparkSession, root: str, name: str, rejects: str) -> DataFrame:
    """Table ``name`` like ``load_table``; what does not parse is written as Parquet to ``rejects`` instead of raising."""
    rows, bad = read_with_rejects(spark, os.path.join(root, f"{name}.csv"), SCHEMAS[name])
    bad.write.mode("overwrite").parquet(rejects)
    return rows
