"""Reading of the tables, Arrow batches, shared scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch; texts can be 100 KB and more, so that a batch stays at some MB.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow in batches that stay small however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into the shared folder and read again: cuts the lineage.

    The shuffle files of the write go as soon as it ends; what reads the rows later starts from the table.
    """
    path = scratch_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def joined_apart(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Inner join on `key` of many rows with one row per key that comes out of an aggregate on it.

    The join is made on another form of the key, so that Spark shuffles both sides for the join itself; only then can
    it split a key that holds very many rows of the left side.
    """
    own = left.withColumn("_left", F.struct(*key))
    other = right.withColumn("_right", F.struct(*key)).drop(*key)
    return own.join(other, F.col("_left") == F.col("_right")).drop("_left", "_right")


def are_stars(edges: DataFrame) -> bool:
    """Whether edges (u, v) with v below u give each u one v that is no u itself: v is then the smallest of its component.

    One aggregate over the ends of the edges, where a further round of components would take two joins.
    """
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).where("ups + down > 1 and ups > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected edges (a, b).

    Large-star and small-star rounds until the edges are stars (`are_stars`); each round is written to the shared folder
    and replaces the one before. Each round meets the edges with the least neighbour of a node by a join that can split a
    node with very many edges.
    """
    current = stored(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = joined_apart(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")  # an edge gives at most one; those that are alike go below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = joined_apart(large, low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        replaced, current = current, stored(small.where("u != v").distinct(), "edges")
        discard(replaced)
        if are_stars(current):
            break
    # every remaining edge points at the smallest node of its component
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
