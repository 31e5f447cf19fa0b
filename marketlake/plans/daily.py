"""The daily chain: bars -> features -> sectors -> rotation, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.operators import features, rotation, sectors
from marketlake.session import cut_lineage
from marketlake.sources import fixtures

__all__ = ["LEVELS", "sector_rotation", "sector_series", "sector_table", "symbol_feature_table"]

LEVELS = {1: "sectorlv1code", 2: "sectorlv2code"}


def symbol_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.symbol_features(fixtures.eod(spark, sf_dir))


def sector_series(spark: SparkSession, sf_dir: str, market: DataFrame | None = None) -> DataFrame:
    """Sector aggregates with index and relative strength, without the nested contributors."""
    daily = sectors.sector_daily(
        symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS
    )
    return sectors.with_relative_strength(sectors.sector_index(daily), market)


def sector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector series written to the checkpoint folder, for plans that read it several times.

    It holds one row per sector and trading day, whatever the size of the bars.
    """
    return cut_lineage(sector_series(spark, sf_dir))


def sector_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sector led each day, and what did it return over the next 5/10/15/20 sessions?"""
    return rotation.rotation_backtest(sector_series(spark, sf_dir))
