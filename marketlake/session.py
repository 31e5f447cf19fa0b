"""Session defaults, shuffle sizes and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

__all__ = ["DEFAULTS", "build_session", "checkpoint_dir", "cut_lineage", "fit_shuffles"]

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # windows over series cost more CPU than bytes: do not merge their tasks for being small
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a table for each partition of a shuffle, the most shuffled bytes that adaptive execution puts into one task, and the
#: most bytes of files that one task reads.
TABLE_BYTES = 4 << 20
TASK_BYTES = "4m"
SPLIT_BYTES = "16m"


def fit_shuffles(spark: SparkSession, path: str) -> int:
    """Shuffles start with as many partitions as the table at ``path`` asks for; returns that number.

    The sorts of a task hold its share of the rows, so a fixed number of partitions lets a task grow with the
    input. The number is only raised and adaptive execution merges what is small, up to ``TASK_BYTES``
    unless the session has its own ``advisoryPartitionSizeInBytes``. Tasks that read files sort too, above the scan
    or before a write; they get ``SPLIT_BYTES`` at most, unless the session has its own ``maxPartitionBytes``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    wanted = -(-size // TABLE_BYTES)
    initial, advisory = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for key, value in ((advisory, TASK_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if wanted > int(spark.conf.get(initial, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(initial, wanted)
    return wanted


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir``. Only a local master may go without it and gets a
    temporary folder; on a cluster a machine-local folder would be lost with its host.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame below the checkpoint folder and continue from the written table.

    For a reduced table that several branches of a plan read: it is computed once, in one
    job, and a lost executor costs no recomputation of what lies before it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/marketlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
