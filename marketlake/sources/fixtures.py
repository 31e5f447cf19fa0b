"""The supplied TPC-H-like tables seen as market data.

supplier = listed symbol, nation / region = sector level 2 / 1, lineitem = trades,
orders = job executions, events = ticks, job statuses and notices.
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlake.session import fit_shuffles

__all__ = [
    "eod", "executions", "load", "notices", "status_stream", "symbols", "ticks", "trades",
]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    fit_shuffles(spark, path)
    return spark.read.parquet(path)


def _symbol_code(c: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 6, "0"))


def _price(cents: Column) -> Column:
    return F.lit(1000.0) + (cents % 10000) / F.lit(100.0)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    return load(spark, sf_dir, "lineitem").select(
        _symbol_code("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("date"),
        cents.alias("cents"),
        _price(cents).alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def _exchange(suppkey: str) -> Column:
    slot = F.col(suppkey) % 3
    return F.when(slot == 0, "HOSE").when(slot == 1, "HNX").otherwise("UPCOM")


def eod(spark: SparkSession, sf_dir: str, since: date | None = None) -> DataFrame:
    """One daily bar per symbol; ``since`` is compared with the stored column, so the scan
    skips row groups by it.

    The first and last trade are found by min/max of the trade order, so the reduction to
    days starts on the map side; it runs on the numeric key and names follow after it.
    """
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    lines = load(spark, sf_dir, "lineitem")
    if since is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(datetime.combine(since, time())).cast("timestamp_ntz"))
    rows = lines.select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), _price(cents).alias("price"),
        F.col("l_quantity").alias("qty"), F.struct("l_orderkey", "l_linenumber", "l_partkey", cents.alias("cents")).alias("seq"),
    )
    bars = rows.groupBy("l_suppkey", "date").agg(
        F.min("seq")["cents"].alias("first_cents"),
        F.max("price").alias("ad_high"),
        F.min("price").alias("ad_low"),
        F.max("seq")["cents"].alias("last_cents"),
        F.sum("qty").alias("nm_volume"),
        F.count("*").alias("n_trades"),
    )
    return bars.select(
        _exchange("l_suppkey").alias("exchange"), _symbol_code("l_suppkey").alias("code"), "date",
        _price(F.col("first_cents")).alias("ad_open"), "ad_high", "ad_low",
        _price(F.col("last_cents")).alias("ad_close"), "nm_volume", "n_trades",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier")
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            _symbol_code("s_suppkey").alias("code"),
            _exchange("s_suppkey").alias("exchange"),
            F.upper(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("sectorlv1code"),
            F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("sectorlv2code"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            "s_suppkey",
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("market_timestamp"),
        F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "P", "PENDING")
        .when(F.col("o_orderpriority") == "1-URGENT", "FAILED")
        .otherwise("RUNNING")
    )
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_log_id"),
        status.alias("status"), F.col("o_orderdate").cast("date").alias("started_on"),
        F.floor("o_totalprice").cast("bigint").alias("records_synced"),
    )


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "RUNNING").when(kind == "click", "PENDING")
        .when(kind == "purchase", "SUCCESS").when(kind == "error", "ERROR")
        .otherwise("PARTIAL_SUCCESS")
    )
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("execution_id"),
        F.col("ts").cast("timestamp").alias("ts"), status.alias("status"),
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("Job "), F.col("event_type"), F.lit(" run "), F.col("event_id").cast("string"),
        F.lit(" for user "), (F.col("user_id") % 5).cast("string"),
    )
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
        text.alias("title"),
    )
