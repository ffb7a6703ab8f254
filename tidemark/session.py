"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Wherever a key may be hot, the join's other side has few rows per key, so
    # the hot one can be split over tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Without it, building a plan records the Python call site of every column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the metrics are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Scratch:
    """The tables and folders made since it was opened; they go when it is closed."""

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch.open.remove(self)
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            place = hadoop_path(self.spark, path)
            place.getFileSystem(hadoop_conf(self.spark)).delete(place, True)


def hadoop_conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables, in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local master
    may go without it; there one machine runs every task.  What lies there goes
    with the open :class:`Scratch`, or else when the session's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tidemark-")
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    place = hadoop_path(spark, path)
    place.getFileSystem(hadoop_conf(spark)).deleteOnExit(place)
    return path


def scratch_table(name: str) -> str:
    """Notes a table of the catalog that goes with the open :class:`Scratch`."""
    if Scratch.open:
        Scratch.open[-1].tables.append(name)
    return name
