"""Queries over bars, symbol features, sectors and rotation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlake.operators import normalize, rotation, sectors
from marketlake.operators.features import FORWARD_WINDOWS, RETURN_WINDOWS
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.daily import (
    LEVELS, sector_rotation, sector_series, symbol_feature_table,
)
from marketlake.plans.registry import big, query, rnd, rounded
from marketlake.sources import fixtures


def _sector_keys() -> list:
    return [big("sector_level"), "sector_code", "date"]


_SECTOR_KEYS_SQL = "sector_level::bigint AS sector_level, sector_code, date"


@query("scan_eod", with_ctes("""
SELECT code, date, ad_open, ad_high, ad_low, ad_close, nm_volume, n_trades FROM eod""", "eod"))
def scan_eod(spark, sf_dir):
    return fixtures.eod(spark, sf_dir).drop("exchange")


@query("scan_eod_pruned", with_ctes("""
SELECT code, date, ad_open, ad_high, ad_low, ad_close, nm_volume, n_trades FROM eod
WHERE date >= DATE '1998-01-01'""", "eod"))
def scan_eod_pruned(spark, sf_dir):
    """The read with a date bound, which is the feature: it reaches the scan."""
    return fixtures.eod(spark, sf_dir, since=date(1998, 1, 1)).drop("exchange")


@query("prepare_eod", with_ctes("""
SELECT code, date, ad_open, ad_high, ad_low, ad_close, nm_volume FROM (
  SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq DESC) rn FROM (
    SELECT *, 0 seq FROM eod UNION ALL
    SELECT code, date, ad_open, ad_high, ad_low,
      CASE WHEN n_trades >= 3 THEN NULL ELSE ad_close + 1 END, nm_volume, n_trades, 1 FROM eod WHERE n_trades > 1))
WHERE rn = 1""", "eod"))
def prepare_eod(spark, sf_dir):
    """A second delivery of the bars with several trades: text prices, some of them unparsable."""
    bars = fixtures.eod(spark, sf_dir)
    text = F.when(F.col("n_trades") >= 3, "n/a").otherwise((F.col("ad_close") + 1).cast("string"))
    first = bars.withColumns({"ad_close": F.col("ad_close").cast("string"), "_seq": F.lit(0)})
    second = bars.where("n_trades > 1").withColumns({"ad_close": text, "_seq": F.lit(1)})
    out = normalize.prepare_eod(first.unionByName(second))
    return out.select("code", "date", "ad_open", "ad_high", "ad_low", "ad_close", "nm_volume")


@query("normalize_eod", with_ctes("""
SELECT code, date, "close", volume FROM (
  SELECT code, date, p AS "close", nm_volume AS volume, row_number() OVER (PARTITION BY code, date ORDER BY seq DESC) rn FROM (
    SELECT *, ad_close p, 0 seq FROM eod UNION ALL
    SELECT *, CASE WHEN n_trades >= 3 THEN NULL ELSE ad_close + 1 END, 1 FROM eod WHERE n_trades > 1)
  WHERE p IS NOT NULL) WHERE rn = 1""", "eod"))
def normalize_eod(spark, sf_dir):
    """Same two deliveries: here a null close is dropped before the last duplicate is chosen."""
    bars = fixtures.eod(spark, sf_dir).drop("exchange")
    bad = F.when(F.col("n_trades") >= 3, F.lit(float("nan"))).otherwise(F.col("ad_close") + 1)
    both = bars.withColumn("_seq", F.lit(0)).unionByName(
        bars.where("n_trades > 1").withColumns({"ad_close": bad, "_seq": F.lit(1)})
    )
    return normalize.normalize_eod(both, keys=("code",))


@query("normalize_columns", """
SELECT l_orderkey::bigint nm_order_key, l_linenumber::bigint line_number, l_quantity total_volume,
  strftime(l_shipdate, '%Y-%m-%d') trading_date, l_extendedprice foreign_buy_value FROM lineitem""")
def normalize_columns(spark, sf_dir):
    """Provider-style names; ``totalVolume`` arrives under two spellings, one of them sparse."""
    raw = fixtures.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("NMOrderKey"),
        F.col("l_linenumber").cast("bigint").alias("lineNumber"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("totalVolume"),
        F.col("l_quantity").alias("total_volume"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("TradingDate"),
        F.col("l_extendedprice").alias("foreign-buy-value"),
    )
    return normalize.normalize_columns(raw)


@query("eod_merge_keep_first", with_ctes("""
SELECT code, date, ad_close FROM (
  SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq) rn FROM (
    SELECT code, date, ad_close, 0 seq FROM eod WHERE date < DATE '1999-01-01' UNION ALL
    SELECT code, date, ad_close + 5, 1 FROM eod WHERE n_trades > 1 OR date >= DATE '1998-06-01'))
WHERE rn = 1""", "eod"))
def eod_merge_keep_first(spark, sf_dir):
    bars = fixtures.eod(spark, sf_dir)
    cols = ["code", "date", "ad_close"]
    existing = bars.where("date < date'1999-01-01'").select(cols)
    incoming = bars.where("n_trades > 1 or date >= date'1998-06-01'").withColumn(
        "ad_close", F.col("ad_close") + 5
    ).select(cols)
    return normalize.eod_merge_keep_first(existing, incoming)


@query("merge_upsert_keep_last", with_ctes("""
SELECT code, date, ad_close, coalesce(n_trades, -1) n_trades FROM (
  SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq DESC) rn FROM (
    SELECT code, date, ad_close, NULL::bigint n_trades, 0 seq FROM eod WHERE date < DATE '1999-01-01' UNION ALL
    SELECT code, date, ad_close + 5, n_trades, 1 FROM eod WHERE n_trades > 1 OR date >= DATE '1998-06-01'))
WHERE rn = 1""", "eod"))
def merge_upsert_keep_last(spark, sf_dir):
    bars = fixtures.eod(spark, sf_dir)
    existing = bars.where("date < date'1999-01-01'").select("code", "date", "ad_close")
    incoming = bars.where("n_trades > 1 or date >= date'1998-06-01'").select(
        "code", "date", (F.col("ad_close") + 5).alias("ad_close"), "n_trades"
    )
    merged = normalize.merge_keep_last(existing, incoming, ["code", "date"])
    return merged.withColumn("n_trades", F.coalesce("n_trades", F.lit(-1)))


@query("symbol_features", with_ctes("""
SELECT date, symbol_key, exchange, symbol, "close", volume, round(return_1d,6) return_1d, round(return_5d,6) return_5d,
  round(return_10d,6) return_10d, round(return_20d,6) return_20d, round(ma20,4) ma20, round(volume_ratio,6) volume_ratio,
  above_ma20, round(forward_return_t5,6) forward_return_t5, round(forward_return_t10,6) forward_return_t10,
  round(forward_return_t15,6) forward_return_t15, round(forward_return_t20,6) forward_return_t20
FROM features""", "features"))
def symbol_features(spark, sf_dir):
    return symbol_feature_table(spark, sf_dir).select(
        "date", "symbol_key", "exchange", "symbol", "close", "volume",
        *rounded(6, *[f"return_{n}d" for n in RETURN_WINDOWS], "volume_ratio"), rnd("ma20", 4),
        "above_ma20", *rounded(6, *[f"forward_return_t{n}" for n in FORWARD_WINDOWS]),
    )


@query("sector_members", with_ctes("""
SELECT upper(exchange) || '-' || upper(code) symbol_key, upper(exchange) exchange, upper(code) symbol,
  sectorlv1code sector_code FROM symbols WHERE sectorlv1code = 'ASIA'""", "symbols"))
def sector_members(spark, sf_dir):
    return sectors.sector_members(fixtures.symbols(spark, sf_dir), 1, "asia")


@query("sector_daily", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, n_members::bigint AS n_members, round(sector_return,6) sector_return, round(volume_ratio,6) volume_ratio,
  round(breadth_above_ma20,6) breadth_above_ma20, round(coverage_ratio,6) coverage_ratio FROM daily""", "daily"))
def sector_daily(spark, sf_dir):
    daily = sectors.sector_daily(symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS)
    return daily.select(
        *_sector_keys(), big("n_members"),
        *rounded(6, "sector_return", "volume_ratio", "breadth_above_ma20", "coverage_ratio"),
    )


define("contributions", """
SELECT *, (1.0 / count(*) OVER d) * coalesce(return_1d, 0) contribution FROM member_days
WINDOW d AS (PARTITION BY sector_level, sector_code, date)""", "member_days")


@query("sector_contributors", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, count(*)::bigint n_contributors,
  round(coalesce(sum(abs(contribution)) FILTER (WHERE rn <= 3) / nullif(sum(abs(contribution)), 0), 0), 6) top_3_contribution_share,
  string_agg(symbol, ',' ORDER BY rn) contributor_order,
  round(coalesce(max(abs(contribution)) / nullif(sum(abs(contribution)), 0), 0), 6) max_share
FROM (SELECT *, row_number() OVER (PARTITION BY sector_level, sector_code, date ORDER BY contribution DESC, symbol) rn FROM contributions)
GROUP BY sector_level, sector_code, date""", "contributions"))
def sector_contributors(spark, sf_dir):
    nested = sectors.sector_contributors(
        symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS
    )
    return nested.select(
        *_sector_keys(), F.size("contributors").cast("bigint").alias("n_contributors"), rnd("top_3_contribution_share"),
        F.array_join(F.transform("contributors", lambda c: c["symbol"]), ",").alias("contributor_order"),
        F.round(F.array_max(F.transform("contributors", lambda c: c["contribution_share"])), 6).alias("max_share"),
    )


@query("sector_contributor_rows", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, symbol, round(1.0 / count(*) OVER d, 6) weight, round(return_1d, 6) AS "return", round(contribution, 6) contribution,
  round(coalesce(abs(contribution) / nullif(sum(abs(contribution)) OVER d, 0), 0), 6) contribution_share, coalesce(above_ma20, false) above_ma20
FROM contributions WINDOW d AS (PARTITION BY sector_level, sector_code, date)""", "contributions"))
def sector_contributor_rows(spark, sf_dir):
    rows = sectors.contributor_rows(symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS)
    return rows.select(*_sector_keys(), "symbol", *rounded(6, "weight", "return", "contribution", "contribution_share"), "above_ma20")


@query("sector_top_contributors", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, "rank", symbol, round(contribution, 6) contribution, round(coalesce(abs(contribution) / nullif(total, 0), 0), 6) contribution_share
FROM (SELECT *, row_number() OVER (PARTITION BY sector_level, sector_code, date ORDER BY contribution DESC, symbol) AS "rank",
  sum(abs(contribution)) OVER (PARTITION BY sector_level, sector_code, date) total FROM contributions) WHERE "rank" <= 3""", "contributions"))
def sector_top_contributors(spark, sf_dir):
    rows = sectors.contributor_rows(symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS)
    return sectors.top_contributors(rows).select(*_sector_keys(), "rank", "symbol", *rounded(6, "contribution", "contribution_share"))


@query("sector_index", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, round(sector_index, 4) sector_index, round(ma20, 4) ma20 FROM indexed""", "indexed"))
def sector_index(spark, sf_dir):
    return sector_series(spark, sf_dir).select(*_sector_keys(), *rounded(4, "sector_index", "ma20"))


@query("relative_strength_market", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, round(sector_return - market_return, 6) relative_strength FROM daily LEFT JOIN (
  SELECT date, c / nullif(lag(c) OVER (ORDER BY date), 0) - 1 market_return FROM (SELECT date, avg(ad_close) c FROM eod GROUP BY date)
) m USING (date)""", "daily"))
def relative_strength_market(spark, sf_dir):
    market_eod = fixtures.eod(spark, sf_dir).groupBy("date").agg(F.avg("ad_close").alias("ad_close"))
    daily = sectors.sector_daily(symbol_feature_table(spark, sf_dir), fixtures.symbols(spark, sf_dir), LEVELS)
    return sectors.with_relative_strength(daily, sectors.market_returns(market_eod)).select(
        *_sector_keys(), rnd("relative_strength")
    )


@query("sector_wave_class", with_ctes(f"SELECT {_SECTOR_KEYS_SQL}, sector_wave FROM waved", "waved"))
def sector_wave_class(spark, sf_dir):
    return sector_series(spark, sf_dir).select(*_sector_keys(), rotation.sector_wave_class().alias("sector_wave"))


@query("rotation_winners", with_ctes(f"""
SELECT {_SECTOR_KEYS_SQL}, round(relative_strength, 6) relative_strength, previous_sector_code, transition,
  lag_sessions::bigint AS lag_sessions FROM winners""", "winners"))
def rotation_winners(spark, sf_dir):
    return rotation.rotation_winners(sector_series(spark, sf_dir)).select(
        *_sector_keys(), rnd("relative_strength"), "previous_sector_code", "transition", big("lag_sessions")
    )


define("sessions", """
SELECT sector_level, date, row_number() OVER (PARTITION BY sector_level ORDER BY date) idx
FROM (SELECT DISTINCT sector_level, date FROM daily)""", "daily")
define("session_returns", "SELECT d.*, idx FROM daily d JOIN sessions USING (sector_level, date)", "sessions")


def _forward_sql(n: int) -> str:
    return (
        f"CASE WHEN count(f.sector_return) FILTER (WHERE f.idx <= w.idx + {n}) = {n} "
        f"THEN round(product(1 + f.sector_return) FILTER (WHERE f.idx <= w.idx + {n}) - 1, 6) END forward_return_t{n}"
    )


@query("rotation_backtest", with_ctes(f"""
SELECT w.date, 'SECTOR_WAVE_V1' strategy, w.sector_level::bigint AS sector_level, w.sector_code, w."rank"::bigint AS "rank",
  round(w.sector_return, 6) sector_return, round(w.relative_strength, 6) relative_strength, w.sector_wave, w.previous_sector_code,
  w.transition, w.lag_sessions::bigint AS lag_sessions, {", ".join(_forward_sql(n) for n in FORWARD_WINDOWS)}
FROM (SELECT w.*, idx FROM winners w JOIN sessions USING (sector_level, date)) w
LEFT JOIN session_returns f ON f.sector_level = w.sector_level AND f.sector_code = w.sector_code AND f.idx BETWEEN w.idx + 1 AND w.idx + 20
GROUP BY w.date, w.sector_level, w.sector_code, w."rank", w.sector_return, w.relative_strength, w.sector_wave,
  w.previous_sector_code, w.transition, w.lag_sessions""", "winners", "session_returns"))
def rotation_backtest(spark, sf_dir):
    return sector_rotation(spark, sf_dir).select(
        "date", "strategy", big("sector_level"), "sector_code", big("rank"),
        *rounded(6, "sector_return", "relative_strength"), "sector_wave", "previous_sector_code",
        "transition", big("lag_sessions"), *rounded(6, *[f"forward_return_t{n}" for n in FORWARD_WINDOWS]),
    )
