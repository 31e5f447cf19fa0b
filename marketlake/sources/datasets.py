"""Stored datasets: layout, reads, validated replacement, manifests, versioned tables."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from marketlake.operators import governance as gov
from marketlake.schemas import PUBLICATION

__all__ = [
    "VersionedTable", "append_events", "dataset_path", "expire_publications", "file_system", "gather", "publish", "read_dataset",
    "read_manifests", "read_optional", "read_published", "replace_dataset", "write_dataset",
]

Check = Callable[[DataFrame], None]


def dataset_path(root: str, dataset: str, partition: Mapping[str, str] | None = None) -> str:
    """``root/dataset/key=value/...`` in lower case; blank parts are an error."""
    named = {"dataset": dataset, **(partition or {})}
    for name, part in named.items():
        if not str(part).strip():
            raise ValueError(f"{name} must not be blank")
    parts = [dataset.strip(), *[f"{k}={str(v).strip()}" for k, v in (partition or {}).items()]]
    return "/".join([root.rstrip("/"), *[p.lower() for p in parts]])


def read_dataset(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A missing dataset and a corrupt file are errors, whatever the session's defaults."""
    reader = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """None when the dataset does not exist: not the same as a dataset without rows."""
    try:
        return read_dataset(spark, path, schema)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def gather(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows of many members in one scan; on a partition column Spark prunes the directories."""
    return df.where(F.col(column).isin(list(values)))


def write_dataset(
    df: DataFrame, path: str, schema: StructType | None = None, partition_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> None:
    """Overwrite; with ``partition_by`` only the partitions that occur in ``df`` are replaced.

    Rows are sorted inside each task and not exchanged: a partition value that holds much
    of the data is written by many tasks.
    """
    out = df if schema is None else df.to(schema)
    if order_by:
        out = out.sortWithinPartitions(*partition_by, *order_by)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the class of its paths."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def replace_dataset(
    df: DataFrame, path: str, schema: StructType | None = None, validate: Check | None = None,
    partition_by: Sequence[str] = (), order_by: Sequence[str] = (),
) -> None:
    """Stage, read back, validate, swap. On any failure the old data stays in place.

    Needs a file system with rename; one writer per dataset. Between its two renames a reader finds no data: readers that
    run beside writers use :func:`publish` and :func:`read_published`.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    staged, old = f"{path}__staging_{mark}", f"{path}__old_{mark}"
    fs, hadoop_path = file_system(spark, path)
    try:
        write_dataset(df, staged, schema, partition_by, order_by)
        if validate is not None:
            validate(read_dataset(spark, staged))
        had_old = fs.exists(hadoop_path(path))
        if had_old and not fs.rename(hadoop_path(path), hadoop_path(old)):
            raise OSError(f"cannot move the current data of {path} aside")
        if not fs.rename(hadoop_path(staged), hadoop_path(path)):
            if had_old:
                fs.rename(hadoop_path(old), hadoop_path(path))
            raise OSError(f"cannot put the staged data of {path} in place")
        if had_old:
            fs.delete(hadoop_path(old), True)
    finally:
        fs.delete(hadoop_path(staged), True)
    spark.catalog.refreshByPath(path)


def append_events(events: DataFrame, path: str) -> None:
    """Keyed JSON events (``key``, ``value``) as files; the same frame fits a Kafka sink."""
    events.select("key", "value").write.mode("append").json(path)


def _manifest_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/_metadata/datasets/{dataset}"


def _claim(spark: SparkSession, root: str, dataset: str) -> int:
    """A publication number of a dataset, above all taken ones; consecutive where writers do not meet.

    A writer leaves a mark of its own under the number and has it when the folder then lists no other mark there. Of two that
    meet at most one sees none, and those that see another go on to a higher number: this asks of the file system no more than
    that a written file is listed.
    """
    folder, own = f"{root.rstrip('/')}/_metadata/publications/{dataset}", uuid.uuid4().hex
    fs, hadoop_path = file_system(spark, folder)

    def marks() -> list[tuple[int, str]]:
        if not fs.exists(hadoop_path(folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hadoop_path(folder))]
        return [(int(n), mark) for n, mark in (name.split("-") for name in names)]

    step = 1
    while True:
        number = max((n for n, _ in marks()), default=0) + step
        fs.create(hadoop_path(f"{folder}/{number:012d}-{own}"), True).close()
        if [mark for n, mark in marks() if n == number] == [own]:
            return number
        step = random.randint(1, 8)


def publish(
    df: DataFrame, root: str, dataset: str, partition: Mapping[str, str], now: datetime,
    inputs: DataFrame | None = None, validate: Check | None = None, order_by: Sequence[str] = (),
) -> DataFrame:
    """Write a partition's data beside what is there, then record its manifest: READY comes last.

    The data go to a folder named by the publication number, which only rises whatever the clock says, and each publication
    appends one immutable manifest row. Readers (:func:`read_published`) follow the manifests, so they see the data before or
    the data after and never none; of a run that fails nothing is left but its number. Superseded folders stay until
    :func:`expire_publications`. ``inputs`` are the manifests the data was built from. The manifests of the dataset come back.
    """
    spark, base = df.sparkSession, dataset_path(root, dataset, partition)
    number = _claim(spark, root, dataset)
    path = f"{base}/publication={number}"
    try:
        write_dataset(df, path, order_by=order_by)
        stored = read_dataset(spark, path)
        if validate is not None:
            validate(stored)
        _record(stored, root, dataset, partition, number, now, inputs)
    except BaseException:
        fs, hadoop_path = file_system(spark, path)
        fs.delete(hadoop_path(path), True)
        raise
    return read_manifests(spark, root, dataset)


def _record(
    stored: DataFrame, root: str, dataset: str, partition: Mapping[str, str], number: int, now: datetime, inputs: DataFrame | None,
) -> None:
    """Append the READY manifest of one publication."""
    spark, base = stored.sparkSession, dataset_path(root, dataset, partition)
    path = f"{base}/publication={number}"
    part = F.create_map(*[F.lit(x) for kv in sorted(partition.items()) for x in kv]) if partition else F.create_map().cast("map<string,string>")
    stats = gov.dataset_stats(stored).withColumn("dataset", F.lit(dataset))
    shape = stats.groupBy("dataset").agg(
        F.max("row_count").alias("rowCount"), F.max("column_count").cast("bigint").alias("columnCount"),
        F.max("min_timestamp").alias("minTimestamp"), F.max("max_timestamp").alias("maxTimestamp"),
        F.array_sort(F.collect_list(F.struct("name", "type", "nullable"))).alias("columns"),
    )
    files = gov.object_checksums(gov.file_objects(spark, f"{path}/*.parquet"))
    sizes = files.agg(F.sum("bytes").alias("totalBytes")).withColumn("dataset", F.lit(dataset))
    head = shape.join(gov.schema_hashes(stats, ["dataset"]), "dataset").join(sizes, "dataset").withColumn("partition", part)
    if inputs is not None:
        links = inputs.agg(F.collect_list(F.struct("dataset", "partition", "dataVersion")).alias("inputs"))
        head = head.join(links.withColumn("dataset", F.lit(dataset)), "dataset")
    else:
        head = head.withColumn("inputs", F.array().cast("array<struct<dataset:string,partition:map<string,string>,dataVersion:string>>"))
    objects = files.select(F.lit(dataset).alias("dataset"), part.alias("partition"), F.element_at(F.split("path", "/"), -1).alias("path"), "checksum")
    versions = gov.data_versions(head, objects)
    row = head.withColumn("pk", gov.partition_key(F.col("partition"))).join(versions, ["dataset", "pk"]).select(
        F.lit(1).alias("version"), "dataset", "partition", F.lit("READY").alias("status"),
        F.lit("/".join(base.split("/")[len(root.rstrip("/").split("/")):])).alias("path"), F.col("data_version").alias("dataVersion"),
        F.col("object_count").cast("bigint").alias("objectCount"), "totalBytes", "rowCount", "columnCount", "columns",
        F.lit(1).alias("schemaVersion"), F.col("schema_hash").alias("schemaHash"),
        F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("generatedAt"), "minTimestamp", "maxTimestamp", "inputs",
        F.lit(None).cast("string").alias("sourceExecutionId"), F.lit(number).cast("bigint").alias("publication"),
    )
    row.to(PUBLICATION).coalesce(1).write.mode("append").json(_manifest_path(root, dataset))


def read_manifests(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return spark.read.schema(PUBLICATION).json(_manifest_path(root, dataset))


def read_published(spark: SparkSession, root: str, dataset: str, members: Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """The current publications of a dataset, or of some partitions, in one scan, with the partition's columns as text and
    ``publication``. A member without a READY publication is an error. The driver reads one path per partition."""
    current = gov.latest_ready(read_manifests(spark, root, dataset))
    held = {r.pk: r for r in current.select("pk", "path", "partition", "publication").collect()}
    if members is not None:
        wanted = {",".join(sorted(f"{k}={v}" for k, v in m.items())): dataset_path(root, dataset, m) for m in members}
        by_path = {f"{root.rstrip('/')}/{r.path}": r for r in held.values()}
        missing = sorted(k for k, path in wanted.items() if path not in by_path)
        if missing:
            raise ValueError(f"{dataset} has no READY publication of {missing}")
        rows = [by_path[path] for path in wanted.values()]
    else:
        rows = list(held.values())
    if not rows:
        raise ValueError(f"{dataset} has no READY publication")
    top = root.rstrip("/")
    paths = sorted(f"{top}/{r.path}/publication={r.publication}" for r in rows)
    schema = read_dataset(spark, paths[0]).schema
    keys = sorted({k for r in rows for k in (r.partition or {})})
    schema = StructType([f for f in schema.fields if f.name not in [*keys, "publication"]])
    for key in keys:
        schema = schema.add(key, "string")
    reader = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    return reader.option("basePath", dataset_path(root, dataset)).schema(schema.add("publication", "long")).parquet(*paths)


def expire_publications(spark: SparkSession, root: str, dataset: str, before: datetime) -> int:
    """Delete the data of publications that a newer READY one replaced before ``before``; the number of folders deleted.

    Manifests stay. ``before`` has to lie further back than the longest read takes.
    """
    ready = read_manifests(spark, root, dataset).where("status = 'READY'").withColumn("pk", gov.partition_key(F.col("partition")))
    following = F.lead("generatedAt").over(W.partitionBy("pk").orderBy("publication"))
    old = ready.withColumn("_next", following).where(F.col("_next") < before.strftime("%Y-%m-%dT%H:%M:%SZ")).select("path", "publication")
    fs, hadoop_path = file_system(spark, root)
    return sum(
        bool(fs.delete(hadoop_path(f"{root.rstrip('/')}/{r.path}/publication={r.publication}"), True)) for r in old.toLocalIterator()
    )


def _nullable(schema: StructType) -> StructType:
    """The same schema with every field, element and value nullable, as files give it back."""
    text = schema.json()
    for key in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{key}":false', f'"{key}":true')
    return StructType.fromJson(json.loads(text))


class VersionedTable:
    """A table rewritten per version; version ``n`` is built from the newest one below ``n``.

    Writing a version again gives the same result, so a streaming batch that is retried
    after a failure does not apply its rows twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), _nullable(schema)

    def _versions(self) -> list[int]:
        fs, hadoop_path = file_system(self.spark, self.path)
        if not fs.exists(hadoop_path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hadoop_path(self.path))]
        done = [n for n in names if n.startswith("v") and fs.exists(hadoop_path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def following(self) -> int:
        """The number of a version on top of all stored ones."""
        return max(self._versions(), default=-1) + 1

    def latest(self, below: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if below is None or v < below]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]:012d}")

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        df.to(self.schema).write.mode("overwrite").parquet(f"{self.path}/v{version:012d}")
        fs, hadoop_path = file_system(self.spark, self.path)
        for old in [v for v in self._versions() if v <= version][:-keep]:
            fs.delete(hadoop_path(f"{self.path}/v{old:012d}"), True)
