"""Sector aggregates per level and day, contributors, sector index, relative strength."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import first_n, require_columns
from marketlake.functions.numeric import gated_avg, safe_div
from marketlake.functions.text import join_symbol_key
from marketlake.operators.normalize import normalize_eod

__all__ = [
    "attach_levels", "contributor_rows", "sector_daily", "explode_levels", "market_returns", "sector_contributors",
    "sector_features", "sector_index", "sector_members", "top_contributors", "with_relative_strength",
]

_SECTOR_DAY = ["sector_level", "sector_code", "date"]


def sector_members(
    symbols: DataFrame, level: int, sector_code: str | None = None, prefix: str = "sectorlv"
) -> DataFrame:
    """(symbol_key, exchange, symbol, sector_code) of a level, first non-blank candidate column wins."""
    column = f"{prefix}{level}code"
    by_lower = {c.lower(): c for c in symbols.columns}
    if column.lower() not in by_lower:
        raise ValueError(f"symbols metadata is missing {column}")
    sector = F.upper(F.col(by_lower[column.lower()]))

    def present(names: tuple[str, ...]) -> Column:
        found = [by_lower[n] for n in names if n in by_lower]
        if not found:
            raise ValueError(f"symbols metadata has none of {', '.join(names)}")
        values = [F.when(F.trim(F.col(c).cast("string")) != "", F.upper(F.col(c).cast("string"))) for c in found]
        return F.coalesce(*values)

    out = symbols.select(
        present(("exchange", "floor", "market")).alias("exchange"),
        present(("code", "symbol", "ticker")).alias("symbol"),
        sector.alias("sector_code"),
    ).where("exchange is not null and symbol is not null and sector_code is not null")
    if sector_code is not None:
        out = out.where(F.col("sector_code") == sector_code.upper())
    return out.select(join_symbol_key(F.col("exchange"), F.col("symbol")).alias("symbol_key"), "*")


def attach_levels(features: DataFrame, symbols: DataFrame, levels: Mapping[int, str]) -> DataFrame:
    """Add the sector columns of ``levels`` to each feature row by symbol.

    The symbol list is the hashed side of a shuffled join: feature rows already lie
    partitioned by (exchange, symbol), so they neither move nor get sorted again, and the
    list needs no size assumption (one row per symbol, spread over all tasks).
    """
    lookup = symbols.select(
        F.upper("exchange").alias("exchange"), F.upper("code").alias("symbol"),
        *[F.upper(F.col(c)).alias(f"_lv{n}") for n, c in levels.items()],
    )
    return features.join(lookup.hint("shuffle_hash"), ["exchange", "symbol"])


def explode_levels(df: DataFrame, levels: Mapping[int, str]) -> DataFrame:
    """One row per (row, level) with a sector code."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("sector_level"), F.col(f"_lv{n}").alias("sector_code")) for n in levels]
    )
    return (
        df.withColumn("_e", F.explode(entries))
        .select("*", "_e.sector_level", "_e.sector_code")
        .drop("_e", *[f"_lv{n}" for n in levels])
        .where("sector_code is not null")
    )


def sector_daily(features: DataFrame, symbols: DataFrame, levels: Mapping[int, str]) -> DataFrame:
    """Mean return, mean volume ratio, breadth and coverage per sector and day.

    Rows are first reduced to sums per (date, all sector codes of a symbol) and only then
    spread over the levels, so the explode multiplies the small side. Coverage divides by
    the distinct symbol codes seen in the sector over the whole input.
    """
    tagged = attach_levels(features, symbols, levels)
    codes = [f"_lv{n}" for n in levels]
    above = F.col("above_ma20").cast("int")
    partial = tagged.groupBy("date", *codes).agg(
        F.count("*").alias("n_rows"),
        F.count("return_1d").alias("n_ret"), F.sum("return_1d").alias("s_ret"),
        F.count("volume_ratio").alias("n_vol"), F.sum("volume_ratio").alias("s_vol"),
        F.count(above).alias("n_above"), F.sum(above).alias("s_above"),
    )
    daily = explode_levels(partial, levels).groupBy(*_SECTOR_DAY).agg(
        F.sum("n_rows").alias("n_members"),
        safe_div(F.sum("s_ret"), F.sum("n_ret")).alias("sector_return"),
        safe_div(F.sum("s_vol"), F.sum("n_vol")).alias("volume_ratio"),
        safe_div(F.sum("s_above"), F.sum("n_above")).alias("breadth_above_ma20"),
    )
    universe = explode_levels(tagged.select("symbol", *codes).distinct(), levels).groupBy(
        "sector_level", "sector_code"
    ).agg(F.countDistinct("symbol").alias("n_universe"))
    return (
        daily.join(universe, ["sector_level", "sector_code"])
        .withColumn("coverage_ratio", safe_div("n_members", "n_universe"))
    )


def contributor_rows(features: DataFrame, symbols: DataFrame, levels: Mapping[int, str]) -> DataFrame:
    """One row per member of a sector and day: weight, contribution, its share of all contributions, above_ma20.

    Members count alike; a member without a return contributes 0. Only a day's sums are joined to the rows, and they are
    reduced on the map side, so no sector day is gathered.
    """
    rows = explode_levels(attach_levels(features, symbols, levels), levels).select(
        *_SECTOR_DAY, "symbol", F.col("return_1d").alias("return"), F.coalesce("above_ma20", F.lit(False)).alias("above_ma20")
    )
    sums = rows.groupBy(*_SECTOR_DAY).agg(F.count("*").alias("_n"), F.sum(F.abs(F.coalesce("return", F.lit(0.0)))).alias("_all"))
    weight, own = F.lit(1.0) / F.col("_n"), F.coalesce("return", F.lit(0.0))
    share = F.coalesce(safe_div(F.abs(own), F.col("_all")), F.lit(0.0))
    return rows.join(sums, list(_SECTOR_DAY)).select(
        *_SECTOR_DAY, "symbol", weight.alias("weight"), "return", (weight * own).alias("contribution"), share.alias("contribution_share"), "above_ma20"
    )


def top_contributors(rows: DataFrame, most: int = 3, salts: int = 16) -> DataFrame:
    """The ``most`` members of each sector and day that contribute most, with their ``rank``; equal ones by symbol.

    In two steps: first within parts of a sector day, so that a sector with most of the rows is spread over tasks.
    """
    best = [F.desc("contribution"), F.col("symbol")]
    salted = first_n(rows.withColumn("_part", F.pmod(F.xxhash64("symbol"), F.lit(salts))), [*_SECTOR_DAY, "_part"], best, most).drop("_part")
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy(*_SECTOR_DAY).orderBy(*best)))
    return ranked.where(F.col("rank") <= most)


def sector_contributors(features: DataFrame, symbols: DataFrame, levels: Mapping[int, str]) -> DataFrame:
    """Nested contributor list and top-3 share per sector and day.

    The list is the requested output, one struct per listed member, so a cell is bounded
    by the number of symbols in the sector. ``_row`` keeps only what the list needs.
    """
    rows = explode_levels(attach_levels(features, symbols, levels), levels).select(
        *_SECTOR_DAY, "symbol", "return_1d", F.coalesce("above_ma20", F.lit(False)).alias("above_ma20")
    )
    grouped = rows.groupBy(*_SECTOR_DAY).agg(
        F.collect_list(F.struct("symbol", F.col("return_1d").alias("return"), "above_ma20")).alias("_rows")
    )
    weight = F.lit(1.0) / F.size("_rows")

    def contribution(r: Column) -> Column:
        return F.col("_weight") * F.coalesce(r["return"], F.lit(0.0))

    ordered = F.array_sort(
        F.transform("_rows", lambda r: F.struct(
            (-contribution(r)).alias("k"), r["symbol"].alias("symbol"), r["return"].alias("ret"),
            r["above_ma20"].alias("above"))))
    total = F.aggregate("_ordered", F.lit(0.0), lambda acc, r: acc + F.abs(r["k"]))
    top3 = F.aggregate(F.slice("_ordered", 1, 3), F.lit(0.0), lambda acc, r: acc + F.abs(r["k"]))
    items = F.transform("_ordered", lambda r: F.struct(
        r["symbol"].alias("symbol"), F.col("_weight").alias("weight"), r["ret"].alias("return"),
        (-r["k"]).alias("contribution"),
        F.coalesce(safe_div(F.abs(r["k"]), F.col("_total")), F.lit(0.0)).alias("contribution_share"),
        r["above"].alias("above_ma20")))
    return (
        grouped.withColumn("_weight", weight)
        .withColumn("_ordered", ordered)
        .withColumn("_total", total)
        .withColumn("top_3_contribution_share", F.coalesce(safe_div(top3, F.col("_total")), F.lit(0.0)))
        .withColumn("contributors", items)
        .withColumn("contributors_json", F.to_json("contributors", {"ignoreNullFields": "false"}))
        .select(*_SECTOR_DAY, "top_3_contribution_share", "contributors", "contributors_json")
    )


def sector_index(daily: DataFrame) -> DataFrame:
    """100 x cumulative product of the daily returns (null = 0) and its MA20."""
    require_columns(daily, [*_SECTOR_DAY, "sector_return"], "sector rows")
    w = W.partitionBy("sector_level", "sector_code").orderBy("date")
    growth = F.product(F.lit(1.0) + F.coalesce("sector_return", F.lit(0.0)))
    indexed = daily.withColumn(
        "sector_index", growth.over(w.rowsBetween(W.unboundedPreceding, 0)) * 100.0
    )
    return indexed.withColumn("ma20", gated_avg("sector_index", w, 20))


def market_returns(market_eod: DataFrame) -> DataFrame:
    """Daily return of a benchmark series, one row per date."""
    prices = normalize_eod(market_eod, keys=()).select("date", "close")
    w = W.orderBy("date")  # a single benchmark series: one row per trading day
    return prices.select("date", (safe_div("close", F.lag("close").over(w)) - 1.0).alias("market_return"))


def with_relative_strength(daily: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Sector return minus market return; without a market the sector return itself."""
    if market is None:
        return daily.withColumn("relative_strength", F.col("sector_return"))
    return (
        daily.join(market, "date", "left")
        .withColumn("relative_strength", F.col("sector_return") - F.col("market_return"))
        .drop("market_return")
    )


def sector_features(
    features: DataFrame, symbols: DataFrame, levels: Mapping[int, str], market: DataFrame | None = None,
) -> DataFrame:
    """The complete sector table: aggregates, index, strength and contributors."""
    daily = with_relative_strength(sector_index(sector_daily(features, symbols, levels)), market)
    return daily.join(sector_contributors(features, symbols, levels), _SECTOR_DAY).select(
        "date", "sector_code", F.col("sector_level").cast("bigint").alias("sector_level"), "sector_index",
        "sector_return", "ma20", "relative_strength", "volume_ratio", "breadth_above_ma20",
        "coverage_ratio", "top_3_contribution_share", "contributors", "contributors_json",
    )
