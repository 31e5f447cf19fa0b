"""Queries over intraday bars, further indicators, alerts, screens, portfolios and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.keyed import keep_last
from marketlake.operators import intraday, oscillators as osc, portfolio, reference_data, screening
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.daily import symbol_feature_table
from marketlake.plans.registry import big, query, rnd, rounded
from marketlake.sources import fixtures

define("ticks", """
SELECT event_id, event_type symbol, ts market_timestamp, value price, 1 + event_id % 100 volume FROM events""")


def _bars_cte(minutes: int) -> str:
    return f"""
SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, market_timestamp) bar_time, min_by(price, event_id) "open", max(price) high, min(price) low,
  max_by(price, event_id) "close", sum(volume)::bigint volume, sum(price * volume) / sum(volume) vwap, count(*) trades
FROM (SELECT event_id, symbol, market_timestamp, price, volume FROM ticks) GROUP BY ALL"""


define("bars_1", _bars_cte(1), "ticks")
define("bars_15", _bars_cte(15), "ticks")
define("bars_60", _bars_cte(60), "ticks")
_BAR_SQL = 'symbol, strftime(bar_time, \'%Y-%m-%d %H:%M\') bar_time, "open", high, low, "close", volume, round(vwap, 6) vwap, trades::bigint trades'


def _shown(bars):
    return bars.select(
        "symbol", F.date_format("bar_time", "yyyy-MM-dd HH:mm").alias("bar_time"), "open", "high", "low", "close",
        "volume", rnd("vwap"), "trades",
    )


@query("trade_bars", with_ctes(f"SELECT {_BAR_SQL} FROM bars_1", "bars_1"))
def trade_bars(spark, sf_dir):
    return _shown(intraday.trade_bars(fixtures.ticks(spark, sf_dir)))


@query("coarser_bars", with_ctes(f"SELECT {_BAR_SQL} FROM bars_15", "bars_15"))
def coarser_bars(spark, sf_dir):
    return _shown(intraday.coarser_bars(intraday.trade_bars(fixtures.ticks(spark, sf_dir)), 15))


def _hourly_features(spark, sf_dir):
    return intraday.intraday_features(intraday.trade_bars(fixtures.ticks(spark, sf_dir), 60), opening_minutes=120)


define("hourly", """
SELECT *, "close" / nullif(session_open, 0) - 1 return_from_open, "close" / nullif(session_vwap, 0) - 1 vwap_distance,
  sqrt(sum(coalesce(bar_return, 0) * coalesce(bar_return, 0)) OVER (PARTITION BY symbol, session ORDER BY bar_time)) realized_volatility,
  max(CASE WHEN bar_time < start + INTERVAL 120 MINUTE THEN high END) OVER s - min(CASE WHEN bar_time < start + INTERVAL 120 MINUTE THEN low END) OVER s opening_range
FROM (SELECT *, "close" / nullif(lag("close") OVER w, 0) - 1 bar_return, first_value("open") OVER w session_open, sum(volume) OVER w session_volume,
  sum(vwap * volume) OVER w / nullif(sum(volume) OVER w, 0) session_vwap, min(bar_time) OVER (PARTITION BY symbol, session) start
  FROM (SELECT *, bar_time::date session FROM bars_60) WINDOW w AS (PARTITION BY symbol, session ORDER BY bar_time))
WINDOW s AS (PARTITION BY symbol, session)""", "bars_60")


@query("intraday_features", with_ctes("""
SELECT symbol, session, strftime(bar_time, '%H:%M') bar_at, round(bar_return, 6) bar_return, round(return_from_open, 6) return_from_open, round(vwap_distance, 6) vwap_distance,
  session_volume::bigint session_volume, round(realized_volatility, 6) realized_volatility, round(opening_range, 6) opening_range FROM hourly""", "hourly"))
def intraday_features(spark, sf_dir):
    return _hourly_features(spark, sf_dir).select(
        "symbol", "session", F.date_format("bar_time", "HH:mm").alias("bar_at"),
        *rounded(6, "bar_return", "return_from_open", "vwap_distance", "realized_volatility", "opening_range"), "session_volume",
    )


@query("intraday_sectors", with_ctes("""
SELECT sector_code, session, strftime(bar_time, '%H:%M') bar_at, members::bigint members, round(breadth, 6) breadth, leader, laggard,
  round(volume / nullif(avg(volume) OVER (PARTITION BY sector_code, session ORDER BY bar_time), 0), 6) relative_volume
FROM (SELECT CASE WHEN symbol IN ('error', 'signup') THEN 'OPS' ELSE 'USE' END sector_code, session, bar_time, count(*) members, avg((return_from_open > 0)::int) breadth,
  sum(volume) volume, first(symbol ORDER BY return_from_open DESC, symbol) leader, first(symbol ORDER BY return_from_open, symbol) laggard FROM hourly GROUP BY ALL)""", "hourly"))
def intraday_sectors(spark, sf_dir):
    members = fixtures.ticks(spark, sf_dir).select("symbol").distinct().withColumn(
        "sector_code", F.when(F.col("symbol").isin("error", "signup"), "OPS").otherwise("USE")
    )
    out = intraday.intraday_sectors(_hourly_features(spark, sf_dir), members)
    return out.select(
        "sector_code", "session", F.date_format("bar_time", "HH:mm").alias("bar_at"), "members", rnd("breadth"), "leader", "laggard", rnd("relative_volume")
    )


@query("tick_intensity", with_ctes("""
SELECT symbol, strftime(window_start, '%Y-%m-%d %H:%M:%S') window_start, trades::bigint trades, volume::bigint volume, round(CASE WHEN count(*) OVER b >= 20 THEN (trades - avg(trades) OVER b) / nullif(stddev_samp(trades) OVER b, 0) END, 6) intensity_z,
  round(last_price / nullif(lag(last_price) OVER w, 0) - 1, 6) window_return
FROM (SELECT symbol, time_bucket(INTERVAL 1800 SECOND, market_timestamp) window_start, time_bucket(INTERVAL 1800 SECOND, market_timestamp)::date session, count(*) trades, sum(volume) volume, max_by(price, event_id) last_price FROM ticks GROUP BY ALL)
WINDOW w AS (PARTITION BY symbol, session ORDER BY window_start), b AS (PARTITION BY symbol, session ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", "ticks"))
def tick_intensity(spark, sf_dir):
    out = intraday.tick_intensity(fixtures.ticks(spark, sf_dir), seconds=1800)
    return out.select(
        "symbol", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "trades", "volume", *rounded(6, "intensity_z", "window_return")
    )


@query("reconcile_bars", with_ctes("""
SELECT symbol, strftime(bar_time, '%Y-%m-%d %H:%M') bar_time, CASE WHEN s.volume IS NULL THEN 'MISSING_IN_STREAM' WHEN s.trades <> b.trades THEN 'DIFFERENT' ELSE 'MATCH' END verdict
FROM bars_60 b LEFT JOIN (SELECT symbol, time_bucket(INTERVAL 60 MINUTE, market_timestamp) bar_time, sum(volume) volume, count(*) trades FROM ticks WHERE price >= 20 GROUP BY ALL) s USING (symbol, bar_time)""", "bars_60"))
def reconcile_bars(spark, sf_dir):
    """The stream side lost the cheap trades."""
    ticks = fixtures.ticks(spark, sf_dir)
    out = intraday.reconcile_bars(intraday.trade_bars(ticks.where("price >= 20"), 60), intraday.trade_bars(ticks, 60))
    return out.select("symbol", F.date_format("bar_time", "yyyy-MM-dd HH:mm").alias("bar_time"), "verdict")


@query("validated_trades", with_ctes("""
SELECT event_id, concat_ws(',', CASE WHEN hour(market_timestamp) < 2 OR hour(market_timestamp) >= 8 THEN 'OUTSIDE_SESSION' END, CASE WHEN price <= 0 THEN 'PRICE' END, CASE WHEN volume <= 0 THEN 'VOLUME' END) violations
FROM ticks""", "ticks"))
def validated_trades(spark, sf_dir):
    return intraday.validated_trades(fixtures.ticks(spark, sf_dir)).select("event_id", F.array_join("violations", ",").alias("violations"))


define("ohlc", "SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - 1 i, lag(ad_close) OVER (PARTITION BY code ORDER BY date) pc, (ad_high + ad_low + ad_close) / 3 tp FROM eod", "eod")


@query("moving_averages", with_ctes("""
SELECT code, date, round(CASE WHEN i >= 19 THEN pow(19/21.0::double, i) * sum(CASE WHEN i < 19 THEN 0 WHEN i = 19 THEN m ELSE ad_close * 2 / 21.0::double END * pow(21/19.0::double, i)) OVER w END, 4) ema,
  round(CASE WHEN i >= 19 THEN stddev_pop(ad_close) OVER f END, 4) stddev, round(CASE WHEN i >= 19 THEN avg(ad_close) OVER f + 2 * stddev_pop(ad_close) OVER f END, 4) bb_upper,
  round(CASE WHEN i >= 19 THEN (sum(ad_close * (i + 1)) OVER f - (i + 1 - 20) * sum(ad_close) OVER f) / 210.0::double END, 3) wma
FROM (SELECT *, avg(ad_close) OVER (PARTITION BY code ORDER BY date) m FROM ohlc)
WINDOW w AS (PARTITION BY code ORDER BY date), f AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""", "ohlc"))
def moving_averages(spark, sf_dir):
    return osc.with_moving_averages(fixtures.eod(spark, sf_dir)).select(
        "code", "date", *rounded(4, "ema", "stddev", "bb_upper"), rnd("wma", 3)
    )


@query("range_indicators", with_ctes("""
SELECT code, date, round(CASE WHEN i >= 13 THEN sum(tr * pow(14/13.0::double, i)) OVER w / sum(pow(14/13.0::double, i)) OVER w END, 4) atr,
  round(stoch_k, 4) stoch_k, round(CASE WHEN count(stoch_k) OVER d >= 3 THEN avg(stoch_k) OVER d END, 4) stoch_d, round(williams_r, 4) williams_r
FROM (SELECT *, coalesce(greatest(ad_high - ad_low, abs(ad_high - pc), abs(ad_low - pc)), 0) tr,
  CASE WHEN i >= 13 THEN (ad_close - min(ad_low) OVER f) * 100 / nullif(max(ad_high) OVER f - min(ad_low) OVER f, 0) END stoch_k,
  CASE WHEN i >= 13 THEN (max(ad_high) OVER f - ad_close) * -100 / nullif(max(ad_high) OVER f - min(ad_low) OVER f, 0) END williams_r
  FROM ohlc WINDOW f AS (PARTITION BY code ORDER BY date ROWS 13 PRECEDING))
WINDOW w AS (PARTITION BY code ORDER BY date), d AS (PARTITION BY code ORDER BY date ROWS 2 PRECEDING)""", "ohlc"))
def range_indicators(spark, sf_dir):
    return osc.with_ranges(fixtures.eod(spark, sf_dir)).select("code", "date", *rounded(4, "atr", "stoch_k", "stoch_d", "williams_r"))


@query("volume_indicators", with_ctes("""
SELECT code, date, sum(coalesce(sign(ad_close - pc) * nm_volume, 0)) OVER w obv, floor(CASE WHEN i >= 13 THEN sum(tp * nm_volume) OVER f / nullif(sum(nm_volume) OVER f, 0) END * 10000 + 0.5) / 10000 vwap
FROM ohlc WINDOW w AS (PARTITION BY code ORDER BY date), f AS (PARTITION BY code ORDER BY date ROWS 13 PRECEDING)""", "ohlc"))
def volume_indicators(spark, sf_dir):
    return osc.with_volume_measures(fixtures.eod(spark, sf_dir)).select(
        "code", "date", "obv", (F.floor(F.col("vwap") * 10000 + 0.5) / 10000).alias("vwap")
    )


@query("directional_indicators", with_ctes("""
SELECT code, date, round(CASE WHEN i >= 25 THEN (25 - (i - arg_max(i, (ad_high, i)) OVER f)) * 100.0::double / 25 END, 4) aroon_up,
  round(CASE WHEN i >= 25 THEN (25 - (i - arg_max(i, (-ad_low, i)) OVER f)) * 100.0::double / 25 END, 4) aroon_down
FROM ohlc WINDOW f AS (PARTITION BY code ORDER BY date ROWS 25 PRECEDING)""", "ohlc"))
def directional_indicators(spark, sf_dir):
    return osc.with_directional(fixtures.eod(spark, sf_dir)).select("code", "date", *rounded(4, "aroon_up", "aroon_down"))


@query("price_alerts", with_ctes("""
SELECT c_custkey alert_id, symbol, condition, date triggered_on, "close" triggered_price FROM (
  SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'above' WHEN 'BUILDING' THEN 'below' WHEN 'FURNITURE' THEN 'cross_up' WHEN 'MACHINERY' THEN 'cross_down' ELSE 'pct_change_up' END condition,
    1000 + abs(c_acctbal) % 100 target FROM customer) a
JOIN (SELECT symbol, "close", previous_close, date, s_suppkey FROM (SELECT f.*, s_suppkey, lag("close") OVER w previous_close, row_number() OVER (PARTITION BY f.symbol ORDER BY date DESC) rn
  FROM features f JOIN symbols s ON s.code = f.symbol WINDOW w AS (PARTITION BY f.symbol ORDER BY date)) WHERE rn = 1) b ON b.s_suppkey = a.c_custkey
WHERE CASE condition WHEN 'above' THEN "close" > target WHEN 'below' THEN "close" < target WHEN 'cross_up' THEN "close" > target AND previous_close <= target
  WHEN 'cross_down' THEN "close" < target AND previous_close >= target ELSE ("close" / previous_close - 1) * 100 >= 1 END""", "features", "symbols"))
def price_alerts(spark, sf_dir):
    """Customer k watches symbol k; the market segment picks the condition."""
    seg = F.col("c_mktsegment")
    condition = (
        F.when(seg == "AUTOMOBILE", "above").when(seg == "BUILDING", "below").when(seg == "FURNITURE", "cross_up")
        .when(seg == "MACHINERY", "cross_down").otherwise("pct_change_up")
    )
    alerts = fixtures.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("alert_id"), F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("symbol"),
        condition.alias("condition"), (F.abs("c_acctbal") % 100 + 1000).alias("target_price"), F.lit(1.0).alias("target_pct"), F.lit(True).alias("is_active"),
    )
    bars = symbol_feature_table(spark, sf_dir).select("symbol", "date", "close")
    return screening.triggered_alerts(alerts, bars)


@query("screener", with_ctes("""
SELECT symbol_key, exchange, "close", round(return_20d, 6) return_20d FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY date DESC) rn FROM features)
WHERE rn = 1 AND exchange = 'HOSE' AND "close" > 1020 AND return_20d < 0.05""", "features"))
def screener(spark, sf_dir):
    latest = keep_last(symbol_feature_table(spark, sf_dir), ["symbol_key"], ["date"])
    found = screening.screen(latest, {"exchange": "HOSE", "close_gt": 1020, "return_20d_lt": 0.05}, sort_by="return_20d")
    return found.select("symbol_key", "exchange", "close", rnd("return_20d"))


@query("portfolio_positions", """
SELECT portfolio_id, symbol, txn_date, n::bigint transactions, (sum(moved) OVER w)::bigint AS position, round((sum(cash) OVER w)::double, 2) cash_flow FROM (
  SELECT l_returnflag portfolio_id, l_suppkey symbol, l_shipdate::date txn_date, count(*) n, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity::bigint ELSE -l_quantity::bigint END) moved,
    sum(CASE WHEN l_linestatus = 'O' THEN -(l_quantity::bigint * l_extendedprice::decimal(20,4) + 1.5) ELSE l_quantity::bigint * l_extendedprice::decimal(20,4) - 1.5 END) cash
  FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY portfolio_id, symbol ORDER BY txn_date)""")
def portfolio_positions(spark, sf_dir):
    txns = fixtures.load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("portfolio_id"), F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("txn_date"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("type"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.lit(1.0).alias("fee"), F.lit(0.5).alias("tax"),
    )
    return portfolio.positions(txns).select(
        "portfolio_id", "symbol", "txn_date", "transactions", "position", F.round(F.col("cash_flow").cast("double"), 2).alias("cash_flow")
    )


@query("industry_paths", """
SELECT 'R' || r_regionkey icb_code, 1::bigint AS depth, 'R' || r_regionkey AS path FROM region UNION ALL
SELECT 'N' || n_nationkey, 2, 'R' || n_regionkey || '/N' || n_nationkey FROM nation UNION ALL
SELECT 'S' || s_suppkey, 3, 'R' || n_regionkey || '/N' || n_nationkey || '/S' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def industry_paths(spark, sf_dir):
    def level(table: str, prefix: str, key: str, parent):
        return fixtures.load(spark, sf_dir, table).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("icb_code"), parent.alias("parent_code")
        )

    tree = (
        level("region", "R", "r_regionkey", F.lit(None).cast("string"))
        .unionByName(level("nation", "N", "n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
        .unionByName(level("supplier", "S", "s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))))
    )
    return reference_data.industry_paths(tree).select("icb_code", big("depth"), F.array_join("path", "/").alias("path"))


@query("statement_columns", """
SELECT o_custkey company, round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END), 2) total_debt,
  round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice WHEN o_orderpriority = '5-LOW' THEN -o_totalprice ELSE 0 END), 2) net_debt,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE 0 END), 2) free_cash_flow
FROM orders GROUP BY o_custkey""")
def statement_columns(spark, sf_dir):
    price, prio, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def total(rule, sign=1):
        return F.sum(F.when(rule, price * sign).otherwise(0.0))

    books = fixtures.load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company")).agg(
        total(prio == "1-URGENT").alias("short_term_debt"), total(prio == "2-HIGH").alias("long_term_debt"),
        total(prio == "5-LOW").alias("cash_and_equivalents"), total(status == "F").alias("net_cash_from_operating_activities"),
        total(status == "P", -1).alias("purchase_fixed_assets"),
    )
    return reference_data.statement_columns(books).select("company", *rounded(2, "total_debt", "net_debt", "free_cash_flow"))
