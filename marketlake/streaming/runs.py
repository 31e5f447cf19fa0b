"""Run a stream over what is available now and read its output back as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marketlake.session import DEFAULTS, checkpoint_dir
from marketlake.sources.datasets import file_system

__all__ = ["drained", "fed_in_parts", "folder_stream", "new_folder", "run_batches", "table_stream"]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table, a folder of files or a single file, as a file stream.

    A run takes all files together unless told otherwise: files have no order in time, and what a
    watermark or a state has passed by would be lost.
    """
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch or 2**31 - 1)
    fs, hadoop_path = file_system(spark, path)
    if fs.getFileStatus(hadoop_path(path)).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All output rows of a stream over the data available now, with their batch number.

    Every batch writes its own folder below the checkpoint folder, so a batch that runs
    again after a failure replaces its rows.
    """
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, DEFAULTS[_PROVIDER])  # the state operators need it
    base = f"{checkpoint_dir(spark).rstrip('/')}/marketlake-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).option("basePath", f"{base}/out").parquet(f"{base}/out")


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/marketlake-{uuid.uuid4().hex}"


def folder_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 2**31 - 1) -> DataFrame:
    """The files of a folder as a stream, in order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, writer: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> None:
    """Run a foreachBatch writer over what is available now, from where ``progress`` says the last run ended."""
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, DEFAULTS[_PROVIDER])
    query = stream.writeStream.foreachBatch(writer).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def fed_in_parts(parts: Sequence[DataFrame], writer: Callable[[str], Callable[[DataFrame, int], None]]) -> str:
    """Parts arrive one after the other in one folder; for each the stream is started anew. Returns the writer's folder."""
    spark = parts[0].sparkSession
    base = new_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        run_batches(folder_stream(spark, f"{base}/in", part.schema), writer(f"{base}/out"), f"{base}/progress")
    return f"{base}/out"
