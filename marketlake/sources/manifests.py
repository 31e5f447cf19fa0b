"""Dataset manifests and dependencies derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlake.operators.governance import dataset_stats
from marketlake.sources.fixtures import load

__all__ = ["dependencies", "lineage_dependencies", "manifests", "table_columns"]


def _version(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def _partition(key: Column) -> Column:
    return F.create_map(F.lit("code"), F.concat(F.lit("s"), key.cast("string")))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``eod`` and one ``indicators`` manifest per supplier.

    Row counts are lineitem counts; the state follows the account balance and the nation;
    suppliers of region 1 have indicators built from an older eod version.
    """
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    base = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).join(counts, "s_suppkey", "left")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    status = F.when(balance < 0, "FAILED").when(balance < 2000, "PROCESSING").otherwise("READY")
    columns = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(False).alias("nullable"))
            for n, t in (("date", "TIMESTAMP"), ("ad_close", "DOUBLE"))
        ]
    )
    current = _version(F.lit("eod"), key.cast("string"), F.lit("2"))
    used = F.when(F.col("n_regionkey") == 1, _version(F.lit("eod"), key.cast("string"), F.lit("1"))).otherwise(current)

    def manifest(name: str, state: Column, version: Column, inputs: Column) -> DataFrame:
        return base.select(
            F.lit(1).alias("version"), F.lit(name).alias("dataset"), _partition(key).alias("partition"), state.alias("status"),
            F.concat(F.lit(f"{name}/s"), key.cast("string"), F.when(F.col("n_nationkey") == 3, "/../x").otherwise(".parquet")).alias("path"),
            version.alias("dataVersion"), F.when(balance > 9500, 0).otherwise(1).cast("bigint").alias("objectCount"),
            (F.coalesce("n", F.lit(0)) * 16).alias("totalBytes"), F.coalesce("n", F.lit(0)).alias("rowCount"),
            F.when(F.col("n_nationkey") == 5, 3).otherwise(2).cast("bigint").alias("columnCount"),
            columns.alias("columns"), F.lit(1).alias("schemaVersion"), _version(F.lit("schema")).alias("schemaHash"),
            F.lit("2001-06-01T00:00:00Z").alias("generatedAt"), inputs.alias("inputs"), "s_suppkey", "n_regionkey",
        )

    none = F.array().cast("array<struct<dataset:string,partition:map<string,string>,dataVersion:string>>")
    link = F.array(F.struct(F.lit("eod").alias("dataset"), _partition(key).alias("partition"), used.alias("dataVersion")))
    eod = manifest("eod", status, current, none)
    built = manifest("indicators", F.when(balance < 500, "PROCESSING").otherwise("READY"), _version(F.lit("ind"), key.cast("string")), link)
    return eod.unionByName(built)


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a job that depends on its eod data in five ways."""
    conditions = ["EXISTS", "READY", "MIN_ROW_COUNT", "MAX_FRESHNESS_LAG", "SUPPORTED_SCHEMA_VERSION"]
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("job"), F.lit("eod").alias("dataset"),
        _partition(F.when(F.col("s_acctbal") > 9000, F.col("s_suppkey") + 1000000000).otherwise(F.col("s_suppkey"))).alias("partition"),
        F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"),
        F.when(F.col("s_acctbal") < 8000, F.lit(600)).cast("bigint").alias("min_row_count"),
        F.when(F.col("s_acctbal") < 5000, 86400 * 365).otherwise(86400).cast("bigint").alias("max_lag_seconds"),
        F.array(F.lit(1)).alias("schema_versions"),
    ).withColumn("enforced", F.col("condition").isin("READY", "MIN_ROW_COUNT", "SUPPORTED_SCHEMA_VERSION"))


def lineage_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's indicators are expected to be built from its current eod data."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        key.alias("job"), F.lit("indicators").alias("dataset"), _partition(key).alias("partition"), F.lit(True).alias("enforced"),
        F.array(F.struct(F.lit("eod").alias("dataset"), _partition(key).alias("partition"))).alias("upstreams"),
    )


def table_columns(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Column statistics of whole tables, tagged by table."""
    out = None
    for t in tables:
        stats = dataset_stats(load(spark, sf_dir, t)).withColumn("dataset", F.lit(t))
        out = stats if out is None else out.unionByName(stats)
    return out
