"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE supplies the size-checked broadcast
# (autoBroadcastJoinThreshold is the bound, sort-merge is the fallback),
# skew-join splitting and partition coalescing.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A shuffled join whose one side has only partitions up to this size (that of
    # a coalesced one) hashes it and needs no sort of the other.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * 1024 * 1024),
    # The driver holds a broadcast table as a hash table of about four times its
    # rows' measured size. A table not yet measured is taken at this many times the
    # size of its Parquet files, which keys and few-valued texts fill far less.
    "spark.sql.autoBroadcastJoinThreshold": str(4 * 1024 * 1024),
    "spark.sql.sources.fileCompressionFactor": "5.0",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "basketlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (driver-made)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to the given directory."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    target = configured or fallback
    if target:
        sc.setCheckpointDir(target)
    return target


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local
    session without one uses a temporary folder, any other raises an error."""
    root = ensure_checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="basketlens-checkpoint-"))
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, removed when it ends."""
    sc = spark.sparkContext
    root = f"{shared_root(spark)}/basketlens-tables/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an intermediate that several branches of a plan read.

    The rows are written once as a Parquet table under the shared folder and
    read back: lineage is cut, a lost executor does not force the upstream
    joins to rerun, and the re-read is columnar with filter pushdown. Never a
    node-local checkpoint."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
