"""Company classification and symbol snapshots seen through the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.sources.fixtures import load, symbols

__all__ = ["companies", "sector_table", "snapshot", "stored_symbols"]


def companies(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """Provider rows with nested levels; nations divisible by 7 have no level-2 class."""
    supplier, nation, region = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    def named(c: str):
        return F.concat(F.lit("VI "), F.col(c)) if lang == "vi" else F.concat(F.initcap(c), F.lit(" & Co-op"))

    def level(code, name):
        return F.struct(code.alias("code"), name.alias("name"))

    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return rows.select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"),
        F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "CT").otherwise("NH").alias("comTypeCode"),
        level(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), named("r_name")).alias("icbLv1"),
        F.when(
            F.col("n_nationkey") % 7 != 0, level(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), named("n_name"))
        ).alias("icbLv2"),
        level(F.when(F.col("s_acctbal") < 0, "").otherwise(F.concat(F.lit("A"), (F.col("s_nationkey") % 4).cast("string"))), named("s_name")).alias("icbLv3"),
        F.lit(None).cast("struct<code:string,name:string>").alias("icbLv4"),
        F.col("s_suppkey").alias("_seq"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol snapshot as a provider sends it: lower-case codes, duplicates, delistings."""
    base = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"),
        F.when(F.col("s_suppkey") % 3 == 0, "hose").when(F.col("s_suppkey") % 3 == 1, "hnx").otherwise("upcom").alias("floor"),
        F.when(F.col("s_acctbal") < 0, "delisted").otherwise("listed").alias("status"),
        F.when(F.col("s_acctbal") < 0, F.lit("2001-02-03")).alias("delistedDate"),
        F.col("s_name").alias("companyName"), F.col("s_acctbal").alias("balance"),
        F.lit("1999-01-01").alias("listedDate"), F.col("s_suppkey").alias("_seq"),
    )
    again = base.where("balance > 5000").withColumns(
        {"code": F.upper("code"), "companyName": F.lit("LATER COPY"), "_seq": F.col("_seq") + 1000000000}
    )
    return base.unionByName(again)


def stored_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol table rows with their metadata map."""
    return symbols(spark, sf_dir).select(
        "code", "exchange", "is_active",
        F.create_map(
            F.lit("sectorLv1Code"), F.col("sectorlv1code"), F.lit("sectorLv2Code"), F.col("sectorlv2code")
        ).alias("meta"),
    )


def sector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sectors: one per nation, source code N<key>, every fourth region inactive."""
    return load(spark, sf_dir, "nation").select(
        F.col("n_name").alias("code"), F.concat(F.lit("VI "), F.col("n_name")).alias("name_vi"),
        F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("name_en"), F.lit("ICB").alias("taxonomy"),
        F.lit(2).alias("taxonomy_level"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source_code"),
        (F.col("n_regionkey") != 3).alias("is_active"),
        F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("origin"), F.lit("stored")).alias("meta"),
    )
