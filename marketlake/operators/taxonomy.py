"""The sector dimension: seeds, records from symbol rows, upsert, active mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions.keyed import keep_last
from marketlake.functions.text import blank_to_null

__all__ = ["SECTOR_SEEDS", "active_mappings", "merged_sector_records", "sector_records", "seed_sectors", "upsert_sectors"]

# The 19 level-2 sectors of the ICB taxonomy (code, native name, English name, source code).
SECTOR_SEEDS = [
    ("FOOD_AND_BEVERAGE", "Thực phẩm và Đồ uống", "Food and Beverage", "3500"),
    ("CHEMICALS", "Hóa chất", "Chemicals", "1300"),
    ("FINANCIAL_SERVICES", "Dịch vụ tài chính", "Financial Services", "8700"),
    ("TRAVEL_AND_LEISURE", "Du lịch và Giải trí", "Travel and Leisure", "5700"),
    ("INDUSTRIAL_GOODS_AND_SERVICES", "Hàng hóa và Dịch vụ công nghiệp", "Industrial Goods and Services", "2700"),
    ("TECHNOLOGY", "Công nghệ", "Technology", "9500"),
    ("BASIC_RESOURCES", "Tài nguyên cơ bản", "Basic Resources", "1700"),
    ("CONSTRUCTION_AND_MATERIALS", "Xây dựng và Vật liệu", "Construction and Materials", "2300"),
    ("OIL_AND_GAS", "Dầu khí", "Oil and Gas", "0500"),
    ("PERSONAL_AND_HOUSEHOLD_GOODS", "Hàng cá nhân và Gia dụng", "Personal and Household Goods", "3700"),
    ("MEDIA", "Truyền thông", "Media", "5500"),
    ("REAL_ESTATE", "Bất động sản", "Real Estate", "8600"),
    ("TELECOMMUNICATIONS", "Viễn thông", "Telecommunications", "6500"),
    ("UTILITIES", "Tiện ích", "Utilities", "7500"),
    ("RETAIL", "Bán lẻ", "Retail", "5300"),
    ("HEALTH_CARE", "Y tế", "Health Care", "4500"),
    ("AUTOMOBILES_AND_PARTS", "Ô tô và Phụ tùng", "Automobiles and Parts", "3300"),
    ("BANKS", "Ngân hàng", "Banks", "8300"),
    ("INSURANCE", "Bảo hiểm", "Insurance", "8500"),
]
_FIELDS = ["code", "name_vi", "name_en", "taxonomy", "taxonomy_level", "source_code", "is_active", "meta"]


def seed_sectors(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The seed rows; with ``existing`` only those whose (taxonomy, source code) is not stored yet."""
    rows = spark.createDataFrame(SECTOR_SEEDS, "code string, name_vi string, name_en string, source_code string")
    seeds = rows.withColumns(
        {"taxonomy": F.lit("ICB"), "taxonomy_level": F.lit(2), "is_active": F.lit(True),
         "meta": F.create_map().cast("map<string,string>")}
    ).select(*_FIELDS)
    return seeds if existing is None else seeds.join(existing, ["taxonomy", "source_code"], "left_anti").select(*_FIELDS)


def sector_records(symbols: DataFrame) -> DataFrame:
    """One record per symbol row and level that has a canonical sector code."""
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("level"), blank_to_null(F.col(f"sectorLv{n}Code")).alias("code"),
                blank_to_null(F.col(f"icbLv{n}Code")).alias("source"), F.col(f"icbLv{n}NameVi").alias("vi"),
                F.col(f"icbLv{n}NameEn").alias("en"),
            )
            for n in (1, 2, 3, 4)
        ]
    )
    return symbols.select("_seq", "code", "exchange", "sectorTaxonomy", F.explode(entries).alias("_e")).where(
        "_e.code is not null"
    ).select(
        "_seq", F.col("_e.code").alias("sector_code"), F.col("sectorTaxonomy").alias("taxonomy"),
        F.col("_e.level").alias("taxonomy_level"), F.col("_e.source").alias("source_code"),
        F.col("_e.vi").alias("name_vi"), F.col("_e.en").alias("name_en"),
        F.col("code").alias("symbol_code"), F.col("exchange").alias("symbol_exchange"),
    )


def merged_sector_records(records: DataFrame) -> DataFrame:
    """One record per (code, taxonomy, level): first non-null value per field in row order,
    metadata of the last row. Plain min/max picks, combined on the map side, so the many
    symbols of one sector never meet in a single list."""
    def first(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_seq"))).alias(name)

    return records.groupBy("sector_code", "taxonomy", "taxonomy_level").agg(
        first("source_code"), first("name_vi"), first("name_en"),
        F.max_by("symbol_code", "_seq").alias("_code"), F.max_by("symbol_exchange", "_seq").alias("_exchange"),
    ).withColumn(
        "meta",
        F.map_filter(
            F.create_map(
                F.lit("source"), F.lit("sync-symbols"), F.lit("sourceSymbolCode"), F.col("_code"),
                F.lit("sourceSymbolExchange"), F.col("_exchange"),
            ),
            lambda _, v: v.isNotNull(),
        ),
    ).drop("_code", "_exchange")


def upsert_sectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on (taxonomy, source code): new non-null values win, metadata merges with the
    new side on top, a touched sector is active again. Records without a code are skipped; of
    records that repeat a key the last by ``_seq`` counts, without it the largest by code and name."""
    new = incoming.where("trim(code) <> ''")
    order = ["_seq"] if "_seq" in new.columns else []
    new = keep_last(new, ["taxonomy", "source_code"], [*order, "code", "name_vi"])
    key = ["taxonomy", "source_code"]
    both = current.alias("o").join(new.alias("n"), key, "full_outer")
    hit = F.col("n.code").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    old_meta, new_meta = F.coalesce("o.meta", empty), F.coalesce("n.meta", empty)
    kept = F.map_filter(old_meta, lambda k, _: ~F.map_contains_key(new_meta, k))
    return both.select(
        F.coalesce("n.code", "o.code").alias("code"),
        F.coalesce("n.name_vi", "o.name_vi").alias("name_vi"),
        F.coalesce("n.name_en", "o.name_en").alias("name_en"),
        "taxonomy",
        F.coalesce("n.taxonomy_level", "o.taxonomy_level").alias("taxonomy_level"),
        "source_code",
        F.when(hit, True).otherwise(F.col("o.is_active")).alias("is_active"),
        F.map_concat(kept, new_meta).alias("meta"),
    )


def active_mappings(sectors: DataFrame, taxonomy: str, level: int) -> DataFrame:
    """Source code to canonical code of the active sectors of a taxonomy level."""
    return (
        sectors.where(F.col("is_active") & (F.col("taxonomy") == taxonomy) & (F.col("taxonomy_level") == level))
        .select(
            "taxonomy", F.col("taxonomy_level").alias("level"), "source_code", F.col("code").alias("canonical_code")
        )
        .orderBy("canonical_code")
    )
