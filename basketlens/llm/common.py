"""Shared helpers: session settings, scratch tables in the cluster's shared
folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole texts travel to Python in small Arrow batches, and shuffle files of a
# finished job are removed at once instead of when the driver collects garbage.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the cluster; a temporary folder only where
    it is unset (a local session in tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder: written once, read by several
    later jobs (a lost executor reruns nothing before them), dropped when no
    longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, files: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """``files``: the rows, of a small table, are dealt over so many files,
        not one for each shuffle partition. On a local folder each file makes
        the executor start ``chmod``, and until such a child has its own image
        the executor's memory may be counted for it once more. ``options`` go
        to the writer."""
        path = f"{self.root}/{name}"
        (df.repartition(files) if files else df).write.options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the columns ``keys``, so that
    no name of ``docs`` meets an internal one; ``select("row.*")`` unpacks it."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def whole(text: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(scratch: Scratch, name: str, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, label) for each
    node that has an edge; label is the smallest node of its component.

    Min-label propagation with pointer jumping: each round takes the smallest
    label among the neighbours and then that label's own label, so chains
    shorten geometrically. Each round is a join and a pre-aggregated minimum;
    only the count of changed labels reaches the driver."""
    both = scratch.table(f"{name}-edges", edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = scratch.table(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                           .select("node", F.least("node", "m").alias("label")))
    step = 0
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = (labels.join(near, "node").withColumn("low", F.least("label", "near"))
               .join(hop, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")))
        step += 1
        new = scratch.table(f"{name}-{step}", new)
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if new.filter("moved").limit(1).count() == 0:
            scratch.drop(f"{name}-edges")
            return labels


LONG, DOUBLE, STRING, INT, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
