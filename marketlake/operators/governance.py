"""Dataset manifests: statistics, hashes, versions, contract rules, dependency checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketlake.functions.keyed import keep_last

__all__ = [
    "block_reasons", "data_versions", "dataset_stats", "dependency_check", "file_objects", "job_guard", "latest_ready",
    "lineage_check", "manifest_violations", "object_checksums", "partition_key", "schema_hashes",
]

# Supported versions, states, name and hash patterns, and the order of a block reason.
MANIFEST_VERSION = 1
SCHEMA_VERSION = 1
STATES = ["READY", "PROCESSING", "FAILED"]
SEGMENT = r"^[a-z0-9][a-z0-9._-]*$"
SHA256 = r"^sha256:[0-9a-f]{64}$"
BLOCK_WORDS = [
    ("MISSING", "missing"), ("NOT_READY", "not ready"), ("STALE", "stale"),
    ("INPUT_VERSION_MISMATCH", "version mismatch"), ("EMPTY", "insufficient rows"), ("ERROR", "errors"),
]
TIME_COLUMNS = ("date", "bar_time", "timestamp")


def partition_key(partition: Column) -> Column:
    """Canonical text of a partition map: ``key=value`` sorted by key, ``_default`` when empty."""
    parts = F.array_sort(F.map_entries(partition))
    text = F.array_join(F.transform(parts, lambda e: F.concat_ws("=", e["key"], e["value"])), "/")
    return F.when(F.size(partition) > 0, text).otherwise("_default")


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def _sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _stored_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "BIGINT"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "VARCHAR"


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row per column: stored type, whether nulls occur; plus row count and time range.

    A single aggregation over all columns; the time range is that of the first of
    ``date``, ``bar_time``, ``timestamp`` present.
    """
    time = next((c for c in TIME_COLUMNS if c in df.columns), None)
    iso = "yyyy-MM-dd'T'HH:mm:ss"

    def edge(fn) -> Column:
        return F.date_format(fn(F.col(time)), iso) if time else F.lit(None).cast("string")

    stats = df.agg(
        F.count("*").alias("row_count"), edge(F.min).alias("min_timestamp"), edge(F.max).alias("max_timestamp"),
        *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("name"), F.lit(_stored_type(f.dataType)).alias("type"),
                (F.col(f"_n{i}") < F.col("row_count")).alias("nullable"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return stats.select("row_count", "min_timestamp", "max_timestamp", F.explode(columns).alias("c")).select(
        F.col("c.name").alias("name"), F.col("c.type").alias("type"), F.col("c.nullable").alias("nullable"),
        "row_count", F.lit(len(df.columns)).alias("column_count"), "min_timestamp", "max_timestamp",
    )


def schema_hashes(columns: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the columns (name, type, nullable) sorted by name, as compact JSON."""
    entry = F.struct("name", "nullable", "type")
    ordered = F.array_sort(F.collect_list(entry))
    return columns.groupBy(*by).agg(_sha256(F.to_json(F.struct(ordered.alias("columns")))).alias("schema_hash"))


def data_versions(datasets: DataFrame, objects: DataFrame) -> DataFrame:
    """Content version of each (dataset, partition).

    Hash over dataset, sorted partition, schema hash, sorted (path, checksum) pairs and
    sorted inputs. Times play no part, so rewriting equal content keeps the version. The
    hash covers the ordered list of a partition's files, so that list is gathered per
    partition; it holds file names and checksums, no data.
    """
    files = objects.withColumn("pk", partition_key(F.col("partition"))).groupBy("dataset", "pk").agg(
        F.array_sort(F.collect_list(F.array("path", "checksum"))).alias("objects")
    )
    inputs = F.transform(
        F.coalesce("inputs", F.array().cast("array<struct<dataset:string,partition:map<string,string>,dataVersion:string>>")),
        lambda i: F.to_json(F.struct(i["dataVersion"].alias("dataVersion"), i["dataset"].alias("dataset"), _sorted_map(i["partition"]).alias("partition"))),
    )
    rows = datasets.withColumn("pk", partition_key(F.col("partition"))).join(files, ["dataset", "pk"])

    def quoted(c: Column) -> Column:
        return F.get(F.regexp_extract_all(F.to_json(F.struct(c.alias("v"))), F.lit(r'(?s)^\{"v":(.*)\}$'), F.lit(1)), F.lit(0))

    canonical = F.concat(
        F.lit('{"dataset":'), quoted(F.col("dataset")), F.lit(',"inputs":['), F.array_join(F.array_sort(inputs), ","),
        F.lit('],"objects":'), F.to_json("objects"), F.lit(',"partition":'), F.to_json(_sorted_map(F.col("partition"))),
        F.lit(',"schemaHash":'), quoted(F.col("schema_hash")), F.lit("}"),
    )
    return rows.select("dataset", "pk", _sha256(canonical).alias("data_version"), F.size("objects").alias("object_count"))


def object_checksums(objects: DataFrame) -> DataFrame:
    """Path, checksum and size in bytes of stored objects; ``objects``: path, content (text or binary)."""
    content = F.col("content").cast("binary")
    return objects.select("path", _sha256(content).alias("checksum"), F.octet_length(content).cast("long").alias("bytes"))


def file_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file below ``path``, one row a file: for objects well below 2 GiB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Add ``violations``: the contract rules a manifest breaks, in rule order."""
    def unsafe(c: Column) -> Column:
        return F.coalesce(~c.rlike(SEGMENT), F.lit(True))

    def unsafe_map(m: Column) -> Column:
        return F.exists(F.map_entries(m), lambda e: unsafe(e["key"]) | unsafe(e["value"]))

    def not_sha(c: Column) -> Column:
        return F.coalesce(~c.rlike(SHA256), F.lit(True))

    ready = F.col("status") == "READY"
    path = F.col("path")
    bad_path = path.isNull() | (F.trim(path) == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    counts = ["objectCount", "totalBytes", "rowCount", "columnCount"]
    negative = F.lit(False)
    for c in counts:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(True))
    bad_column = F.exists("columns", lambda c: F.coalesce(F.trim(c["name"]) == "", F.lit(True)) | F.coalesce(F.trim(c["type"]) == "", F.lit(True)))
    bad_input = F.exists("inputs", lambda i: unsafe(i["dataset"]) | i["partition"].isNull() | unsafe_map(i["partition"]) | not_sha(i["dataVersion"]))
    rules = [
        (F.col("version") != MANIFEST_VERSION, "UNSUPPORTED_VERSION"),
        (F.col("schemaVersion") != SCHEMA_VERSION, "UNSUPPORTED_SCHEMA_VERSION"),
        (unsafe(F.col("dataset")), "DATASET_NAME"),
        (F.col("partition").isNull() | unsafe_map(F.col("partition")), "PARTITION"),
        (bad_path, "PATH"),
        (F.coalesce(~F.col("status").isin(STATES), F.lit(True)), "STATUS"),
        (F.coalesce(F.trim("generatedAt") == "", F.lit(True)), "GENERATED_AT"),
        (negative, "NEGATIVE_COUNT"),
        (F.col("columns").isNull() | (F.col("columnCount") != F.size("columns")), "COLUMN_COUNT"),
        (F.coalesce(bad_column, F.lit(False)), "COLUMN"),
        (F.col("inputs").isNull(), "INPUTS_REQUIRED"),
        (F.coalesce(bad_input, F.lit(False)), "INPUT"),
        (ready & (F.col("objectCount") < 1), "READY_OBJECT_COUNT"),
        (ready & not_sha(F.col("dataVersion")), "READY_DATA_VERSION"),
        (ready & not_sha(F.col("schemaHash")), "READY_SCHEMA_HASH"),
    ]
    found = [F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for broken, code in rules]
    return manifests.withColumn("violations", F.array_compact(F.array(*found)))


def latest_ready(manifests: DataFrame, order: str = "generatedAt") -> DataFrame:
    """The current manifest of each (dataset, partition): the READY one with the highest publication number, which orders
    two within a second too; where manifests carry none, the newest by ``order``."""
    newest = ["publication", order] if "publication" in manifests.columns else [order]
    return keep_last(
        manifests.where("status = 'READY'").withColumn("pk", partition_key(F.col("partition"))), ["dataset", "pk"], newest
    )


def dependency_check(dependencies: DataFrame, manifests: DataFrame, now: datetime) -> DataFrame:
    """Status of each dependency of a job against the current manifests.

    ``dependencies``: job, dataset, partition, condition, enforced, and the parameters
    ``min_row_count``, ``max_lag_seconds``, ``schema_versions`` where a condition needs them.
    A missing or ill-typed parameter is an ERROR. CURRENT_INPUTS is ``lineage_check``.
    """
    known = manifests.select(
        "dataset", partition_key(F.col("partition")).alias("pk"), F.col("status").alias("_status"),
        F.col("rowCount").alias("_rows"), F.col("schemaVersion").alias("_schema"),
        F.try_to_timestamp("generatedAt").alias("_at"), F.lit(True).alias("_found"),
    )
    kind = F.col("condition")
    found, is_ready = F.coalesce("_found", F.lit(False)), F.coalesce(F.col("_status") == "READY", F.lit(False))
    lag = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("_at")
    rows_ok = F.col("_rows") >= F.col("min_row_count")
    no_param = (
        ((kind == "MIN_ROW_COUNT") & F.col("min_row_count").isNull())
        | ((kind == "MAX_FRESHNESS_LAG") & F.col("max_lag_seconds").isNull())
        | ((kind == "SUPPORTED_SCHEMA_VERSION") & F.col("schema_versions").isNull())
    )
    status = (
        F.when(no_param, "ERROR")
        .when(~kind.isin("EXISTS", "READY", "MIN_ROW_COUNT", "PARTITION_MATCH", "SUPPORTED_SCHEMA_VERSION", "MAX_FRESHNESS_LAG"), "ERROR")
        .when(~found, "MISSING")
        .when(kind.isin("EXISTS", "PARTITION_MATCH"), "READY")
        .when(~is_ready, "NOT_READY")
        .when((kind == "MIN_ROW_COUNT") & ~rows_ok, "EMPTY")
        .when((kind == "SUPPORTED_SCHEMA_VERSION") & ~F.array_contains("schema_versions", F.col("_schema")), "ERROR")
        .when((kind == "MAX_FRESHNESS_LAG") & F.coalesce(lag > F.col("max_lag_seconds"), F.lit(True)), "STALE")
        .otherwise("READY")
    )
    keyed = dependencies.withColumn("pk", partition_key(F.col("partition")))
    return keyed.join(known, ["dataset", "pk"], "left").select(
        "job", "dataset", "pk", "condition", "enforced", status.alias("status")
    )


def lineage_check(dependencies: DataFrame, manifests: DataFrame) -> DataFrame:
    """CURRENT_INPUTS: was a dataset built from the current versions of its upstreams?

    ``dependencies``: job, dataset, partition, enforced, ``upstreams`` (array of dataset and
    partition). The first failing upstream in listed order decides the status.
    """
    current = manifests.select(
        "dataset", partition_key(F.col("partition")).alias("pk"), F.col("status").alias("_status"),
        F.col("dataVersion").alias("_version"), F.col("inputs").alias("_inputs"), F.lit(True).alias("_found"),
    )
    base = dependencies.withColumn("pk", partition_key(F.col("partition"))).join(current, ["dataset", "pk"], "left")
    own = (
        F.when(F.col("upstreams").isNull(), "ERROR")
        .when(F.col("_found").isNull(), "MISSING")
        .when(F.coalesce(F.col("_status") != "READY", F.lit(True)), "NOT_READY")
        .when(F.coalesce(F.size("_inputs"), F.lit(0)) <= 0, "ERROR")
    )
    base = base.select("job", "dataset", "pk", "enforced", own.alias("_own"), "upstreams", "_inputs")
    recorded = F.filter(
        "_inputs", lambda i: (i["dataset"] == F.col("up")) & (partition_key(i["partition"]) == F.col("up_pk"))
    )
    steps = (
        base.where("_own is null")
        .select("job", "dataset", "pk", "_inputs", F.posexplode("upstreams").alias("pos", "u"))
        .select("job", "dataset", "pk", "pos", "_inputs", F.col("u.dataset").alias("up"), partition_key(F.col("u.partition")).alias("up_pk"))
        .withColumn("_recorded", F.get(recorded, F.lit(0))["dataVersion"])
        .drop("_inputs")
        .join(
            current.select(F.col("dataset").alias("up"), F.col("pk").alias("up_pk"), "_status", "_version", "_found"),
            ["up", "up_pk"], "left",
        )
    )
    step = (
        F.when(F.col("_recorded").isNull(), "ERROR").when(F.col("_found").isNull(), "MISSING")
        .when(F.coalesce(F.col("_status") != "READY", F.lit(True)), "NOT_READY")
        .when(F.coalesce(F.col("_recorded") != F.col("_version"), F.lit(True)), "INPUT_VERSION_MISMATCH")
    )
    failed = steps.withColumn("_step", step).where("_step is not null").groupBy("job", "dataset", "pk").agg(
        F.min_by("_step", "pos").alias("_step")
    )
    return base.join(failed, ["job", "dataset", "pk"], "left").select(
        "job", "dataset", "pk", F.lit("CURRENT_INPUTS").alias("condition"), "enforced",
        F.coalesce("_own", "_step", F.lit("READY")).alias("status"),
    )


def block_reasons(checks: DataFrame) -> DataFrame:
    """Per job: how many enforced checks failed in which way, in a fixed order of words."""
    failed = checks.where("enforced and status <> 'READY'")
    counts = [F.count(F.when(F.col("status") == s, 1)) for s, _ in BLOCK_WORDS]
    parts = [F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {word}"))) for c, (_, word) in zip(counts, BLOCK_WORDS)]
    return failed.groupBy("job").agg(F.concat_ws(", ", *parts).alias("block_reason"))


def job_guard(checks: DataFrame) -> DataFrame:
    """Verdict per job: enforced failures block, the others only warn."""
    bad = F.col("status") != "READY"
    verdict = F.when(F.bool_or(bad & F.col("enforced")), "BLOCKED").when(F.bool_or(bad), "READY_WITH_WARNINGS").otherwise("READY")
    return checks.groupBy("job").agg(verdict.alias("verdict"))
