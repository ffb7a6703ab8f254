"""A corpus pipeline: quality, line dedup, near duplicates, benchmark contamination, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet into the shared folder and read again as the next
stage's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, quality, sentencepiece_scan
from tidemark.llm.common import read, stored
from tidemark.llm.registry import register

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5; scored in one pass, so that texts are not shuffled."""
    model = spark.sparkContext.broadcast(quality.train(docs, read(spark, sf_dir, "labels")))
    return quality.keep_rows(docs.select(*COLUMNS), model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go (one occurrence stays); documents of which nothing is left go with them."""
    found = line_dedup.remove_boilerplate(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim(F.translate("text", "\n", ""))) == 0)
    found = found.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with `row`, a 64-bit hash of doc_id and text: rows without an id, or that share one, are told apart."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates, a null id after all others; repeated rows once."""
    rows = keyed(docs)
    found = jaccard_join.components(rows.select(F.col("row").alias("doc_id"), "text"))
    found = stored(found.where("component_id is not null").select(F.col("doc_id").alias("row"), "component_id").distinct(), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    gone = found.select("row").join(first.select("first.row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").dropDuplicates(["row"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not name."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows.select(F.col("row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bad, "row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of the remaining documents."""
    return sentencepiece_scan.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("sentencepiece", encoded),
]

#: The classifier and the encoding have no SQL.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
