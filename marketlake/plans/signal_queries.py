"""Queries over indicators, signals, the signal history and its outcomes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from marketlake.functions.text import join_symbol_key
from marketlake.operators import history, indicators, signals
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.registry import big, query, rnd, rounded
from marketlake.sources import fixtures

NOW = datetime(2030, 1, 1)  # clock value of the queries; no output column depends on it
_KEY = ("symbol_key",)


def symbol_eod(spark, sf_dir: str) -> DataFrame:
    return fixtures.eod(spark, sf_dir).withColumn("symbol_key", join_symbol_key(F.col("exchange"), F.col("code")))


def indicator_table(spark, sf_dir: str, *names: str) -> DataFrame:
    return indicators.indicators(symbol_eod(spark, sf_dir), names, keys=_KEY)


def scored(spark, sf_dir: str) -> DataFrame:
    """Signal of every symbol on every date, as history rows; bars and indicators stay in one pass."""
    table = indicators.indicators(
        symbol_eod(spark, sf_dir), ["MA20", "MA50", "RSI14", "MACD"], keys=_KEY, keep=["ad_close"]
    )
    return signals.score_rows(table).withColumns(
        {
            "exchange": F.substring_index("symbol_key", "-", 1), "strategy": F.lit(signals.STRATEGY),
            "timeframe": F.lit("1d"), "revision": F.lit(1),
        }
    )


define("bars", """
SELECT exchange || '-' || code symbol_key, e.*, row_number() OVER (PARTITION BY code ORDER BY date) - 1 i,
  ad_close - lag(ad_close) OVER (PARTITION BY code ORDER BY date) chg FROM eod e JOIN symbols USING (code)""", "eod", "symbols")
# closed form of the recursions; the series are short enough for plain powers
define("emas", """
SELECT *, CASE WHEN i >= 25 THEN e12 - e26 END macd FROM (SELECT *,
  pow(11/13.0::double, i) * sum(CASE WHEN i < 11 THEN 0 WHEN i = 11 THEN m ELSE ad_close * 2 / 13.0::double END * pow(13/11.0::double, i)) OVER w e12,
  pow(25/27.0::double, i) * sum(CASE WHEN i < 25 THEN 0 WHEN i = 25 THEN m ELSE ad_close * 2 / 27.0::double END * pow(27/25.0::double, i)) OVER w e26,
  sum(greatest(chg, 0) * pow(14/13.0::double, i)) OVER w gain, sum(greatest(-chg, 0) * pow(14/13.0::double, i)) OVER w loss
FROM (SELECT *, avg(ad_close) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) m FROM bars)
WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))""", "bars")
define("ind", """
SELECT *, macd - macd_signal macd_hist FROM (SELECT *,
  CASE WHEN i >= 14 THEN 100 * gain / nullif(gain + loss, 0) END rsi14,
  CASE WHEN i >= 33 THEN pow(4/5.0::double, i) * sum(CASE WHEN i < 33 THEN 0 WHEN i = 33 THEN mm ELSE macd / 5 END * pow(5/4.0::double, i)) OVER w END macd_signal,
  CASE WHEN count(*) OVER w20 >= 20 THEN avg(ad_close) OVER w20 END ma20, CASE WHEN count(*) OVER w50 >= 50 THEN avg(ad_close) OVER w50 END ma50
FROM (SELECT *, avg(macd) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) mm FROM emas)
WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING),
  w20 AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING), w50 AS (PARTITION BY code ORDER BY date ROWS 49 PRECEDING))""", "emas")
define("scored", """
SELECT *, CASE WHEN missing <> '' THEN 'NO_DECISION' WHEN score >= 3 THEN 'BULLISH' WHEN score <= -3 THEN 'BEARISH' ELSE 'NEUTRAL' END signal,
  CASE WHEN missing <> '' THEN missing ELSE concat_ws(',',
    CASE WHEN ad_close > ma50 THEN 'PRICE_ABOVE_MA50' WHEN ad_close < ma50 THEN 'PRICE_BELOW_MA50' ELSE 'PRICE_EQUALS_MA50' END,
    CASE WHEN ma20 > ma50 THEN 'MA20_ABOVE_MA50' WHEN ma20 < ma50 THEN 'MA20_BELOW_MA50' ELSE 'MA20_EQUALS_MA50' END,
    CASE WHEN rsi14 > 55 THEN 'RSI14_ABOVE_55' WHEN rsi14 < 45 THEN 'RSI14_BELOW_45' ELSE 'RSI14_NEUTRAL' END,
    CASE WHEN macd > macd_signal THEN 'MACD_ABOVE_SIGNAL' WHEN macd < macd_signal THEN 'MACD_BELOW_SIGNAL' ELSE 'MACD_EQUALS_SIGNAL' END,
    'SCORE_' || score) END reasons
FROM (SELECT symbol_key, date signal_date, ad_close, ad_close signal_price, ma20, ma50, rsi14, macd, macd_signal,
  concat_ws(',', CASE WHEN ma20 IS NULL THEN 'MISSING_VALUE_MA20' END, CASE WHEN ma50 IS NULL THEN 'MISSING_VALUE_MA50' END,
    CASE WHEN rsi14 IS NULL THEN 'MISSING_VALUE_RSI14' END, CASE WHEN macd IS NULL THEN 'MISSING_VALUE_MACD' END,
    CASE WHEN macd_signal IS NULL THEN 'MISSING_VALUE_MACD_SIGNAL' END) missing,
  coalesce(CASE WHEN ma20 IS NULL OR ma50 IS NULL OR rsi14 IS NULL OR macd IS NULL OR macd_signal IS NULL THEN 0 ELSE
    2 * sign(ad_close - ma50)::int + sign(ma20 - ma50)::int + CASE WHEN rsi14 > 55 THEN 1 WHEN rsi14 < 45 THEN -1 ELSE 0 END
    + sign(macd - macd_signal)::int END, 0) score FROM ind)""", "ind")


@query("indicator_ma", with_ctes("SELECT symbol_key, date, round(ma20,4) ma20, round(ma50,4) ma50 FROM ind", "ind"))
def indicator_ma(spark, sf_dir):
    return indicator_table(spark, sf_dir, "MA20", "MA50").select("symbol_key", "date", *rounded(4, "ma20", "ma50"))


@query("indicator_rsi14", with_ctes("SELECT symbol_key, date, round(rsi14,4) rsi14 FROM ind", "ind"))
def indicator_rsi14(spark, sf_dir):
    return indicator_table(spark, sf_dir, "RSI14").select("symbol_key", "date", rnd("rsi14", 4))


@query("indicator_macd", with_ctes("""
SELECT symbol_key, date, round(macd,4) macd, round(macd_signal,4) macd_signal, round(macd_hist,4) macd_hist FROM ind""", "ind"))
def indicator_macd(spark, sf_dir):
    return indicator_table(spark, sf_dir, "MACD").select(
        "symbol_key", "date", *rounded(4, "macd", "macd_signal", "macd_hist")
    )


@query("indicator_ichimoku", with_ctes("""
SELECT symbol_key, date, round(CASE WHEN n >= 52 THEN t END,4) ichimoku_tenkan, round(CASE WHEN n >= 52 THEN k END,4) ichimoku_kijun,
  round(CASE WHEN n >= 52 THEN lag((t + k) / 2, 26) OVER w END,4) ichimoku_span_a, round(CASE WHEN n >= 52 THEN lag(b, 26) OVER w END,4) ichimoku_span_b,
  CASE WHEN n >= 52 THEN lead(ad_close, 26) OVER w END ichimoku_chikou
FROM (SELECT *, count(*) OVER (PARTITION BY code) n,
  CASE WHEN i >= 8 THEN (max(ad_high) OVER (w ROWS 8 PRECEDING) + min(ad_low) OVER (w ROWS 8 PRECEDING)) / 2 END t,
  CASE WHEN i >= 25 THEN (max(ad_high) OVER (w ROWS 25 PRECEDING) + min(ad_low) OVER (w ROWS 25 PRECEDING)) / 2 END k,
  CASE WHEN i >= 51 THEN (max(ad_high) OVER (w ROWS 51 PRECEDING) + min(ad_low) OVER (w ROWS 51 PRECEDING)) / 2 END b
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
WINDOW w AS (PARTITION BY code ORDER BY date)""", "bars"))
def indicator_ichimoku(spark, sf_dir):
    lines = ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_span_a", "ichimoku_span_b"]
    return indicator_table(spark, sf_dir, "ICHIMOKU").select(
        "symbol_key", "date", *rounded(4, *lines), "ichimoku_chikou"
    )


@query("signal_history_full", with_ctes("""
SELECT symbol_key, signal_date, signal, signal_price, score::bigint score FROM scored""", "scored"))
def signal_history_full(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol_key", "signal_date", "signal", "signal_price", big("score"))


@query("signal_reasons", with_ctes("SELECT symbol_key, signal_date, reasons FROM scored", "scored"))
def signal_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol_key", "signal_date", F.array_join("reason_codes", ",").alias("reasons"))


define("latest", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY signal_date DESC) rn FROM scored) WHERE rn = 1""", "scored")


@query("signal_latest", with_ctes("""
SELECT symbol_key, signal_date, signal, signal_price, score::bigint score, reasons FROM latest""", "latest"))
def signal_latest(spark, sf_dir):
    """The join of the two datasets, as when both are stored."""
    eod = symbol_eod(spark, sf_dir)
    table = indicators.indicators(eod, ["MA20", "MA50", "RSI14", "MACD"], keys=_KEY)
    return signals.latest_signals(eod, table).select(
        "symbol_key", "signal_date", "signal", "signal_price", big("score"),
        F.array_join("reason_codes", ",").alias("reasons"),
    )


@query("signal_no_decision", with_ctes("""
SELECT s.exchange || '-' || s.code symbol_key, coalesce(l.signal, 'NO_DECISION') signal, coalesce(l.score, 0)::bigint score,
  coalesce(l.reasons, 'NO_OVERLAPPING_EOD_INDICATOR_DATES') reasons
FROM symbols s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY signal_date DESC) rn FROM scored
    WHERE symbol_key NOT LIKE 'UPCOM-%') WHERE rn = 1) l
ON l.symbol_key = s.exchange || '-' || s.code""", "scored"))
def signal_no_decision(spark, sf_dir):
    """One exchange has no indicators at all."""
    eod = symbol_eod(spark, sf_dir)
    table = indicators.indicators(
        eod.where("exchange <> 'UPCOM'"), ["MA20", "MA50", "RSI14", "MACD"], keys=_KEY
    )
    listed = fixtures.symbols(spark, sf_dir).select(
        join_symbol_key(F.col("exchange"), F.col("code")).alias("symbol_key")
    )
    return signals.latest_signals(eod, table, listed).select(
        "symbol_key", "signal", big("score"), F.array_join("reason_codes", ",").alias("reasons")
    )


define("deciding", "SELECT * FROM scored WHERE signal <> 'NO_DECISION'", "scored")


@query("signal_changes", with_ctes("""
SELECT symbol_key, signal_date, signal, previous_signal, coalesce(previous_signal <> signal, false) signal_changed FROM (
  SELECT *, lag(signal) OVER (PARTITION BY symbol_key ORDER BY signal_date) previous_signal FROM deciding)""", "deciding"))
def signal_changes(spark, sf_dir):
    return signals.deciding_changes(scored(spark, sf_dir)).select(
        "symbol_key", "signal_date", "signal", "previous_signal", "signal_changed"
    )


@query("signal_transitions", with_ctes("""
SELECT l.symbol_key, l.signal_date, l.signal, p.previous_signal, (l.signal <> 'NO_DECISION' AND p.previous_signal IS NOT NULL AND p.previous_signal <> l.signal) signal_changed,
  l.signal <> 'NO_DECISION' persisted
FROM latest l LEFT JOIN (SELECT symbol_key, max_by(signal, signal_date) previous_signal FROM deciding WHERE signal_date < DATE '2001-01-01' GROUP BY symbol_key) p
USING (symbol_key)""", "latest", "deciding"))
def signal_transitions(spark, sf_dir):
    rows = scored(spark, sf_dir)
    recorded = rows.where("signal_date < date'2001-01-01'")
    return history.signal_transitions(recorded, signals.latest_only(rows)).select(
        "symbol_key", "signal_date", "signal", "previous_signal", "signal_changed", "persisted"
    )


@query("signal_upsert", with_ctes("""
SELECT symbol_key, signal_date, signal, signal_price,
  CASE WHEN signal_date >= DATE '1998-06-01' AND signal_date < DATE '1999-01-01' THEN 4 WHEN signal_date < DATE '1998-06-01' THEN 3 ELSE 1 END::bigint revision,
  CASE WHEN signal_date < DATE '1999-01-01' THEN 1234.5 END::double actual_price_t5 FROM deciding""", "deciding"))
def signal_upsert(spark, sf_dir):
    """Stored rows carry an outcome and revision 3; a rerun from mid-1998 overlaps them."""
    rows = scored(spark, sf_dir)
    stored = rows.where("signal_date < date'1999-01-01' and signal <> 'NO_DECISION'").withColumns(
        {"revision": F.lit(3), "actual_price_t5": F.lit(1234.5)}
    )
    rerun = rows.where("signal_date >= date'1998-06-01'")
    return history.upsert_signals(stored, rerun, NOW).select(
        "symbol_key", "signal_date", "signal", "signal_price", big("revision"), "actual_price_t5"
    )


define("placed", """
SELECT symbol_key, date, lead(ad_close,5) OVER w p5, lead(ad_close,10) OVER w p10, lead(ad_close,15) OVER w p15, lead(ad_close,20) OVER w p20
FROM bars WHERE symbol_key NOT LIKE 'UPCOM-%' WINDOW w AS (PARTITION BY code ORDER BY date)""", "bars")
define("placed_all", """
SELECT symbol_key, date, lead(ad_close,5) OVER w p5, lead(ad_close,10) OVER w p10, lead(ad_close,15) OVER w p15, lead(ad_close,20) OVER w p20
FROM bars WINDOW w AS (PARTITION BY symbol_key ORDER BY date)""", "bars")
_OUTCOMES_SQL = ", ".join(
    f"round(p{n},4) actual_price_t{n}, round((p{n} - signal_price) / nullif(signal_price, 0),6) actual_return_t{n}"
    for n in history.OUTCOME_WINDOWS
)


def _listed_eod(spark, sf_dir: str) -> DataFrame:
    """EOD rows without one exchange, so that some signals have no prices."""
    return symbol_eod(spark, sf_dir).where("exchange <> 'UPCOM'")


@query("signal_outcomes", with_ctes(f"""
SELECT d.symbol_key, signal_date, signal, {_OUTCOMES_SQL} FROM deciding d LEFT JOIN placed_all p ON p.symbol_key = d.symbol_key AND p.date = d.signal_date""",
    "deciding", "placed_all"))
def signal_outcomes(spark, sf_dir):
    deciding = scored(spark, sf_dir).where("signal <> 'NO_DECISION'")
    out = history.fill_outcomes(deciding, symbol_eod(spark, sf_dir), NOW)
    return out.select(
        "symbol_key", "signal_date", "signal",
        *rounded(4, *[f"actual_price_t{n}" for n in history.OUTCOME_WINDOWS]),
        *rounded(6, *[f"actual_return_t{n}" for n in history.OUTCOME_WINDOWS]),
    )


@query("outcome_summary", with_ctes("""
SELECT count(*)::bigint records_scanned, count(p5)::bigint records_updated,
  count(DISTINCT CASE WHEN d.symbol_key LIKE 'UPCOM-%' THEN d.symbol_key END)::bigint missing_eod_count
FROM deciding d LEFT JOIN placed p ON p.symbol_key = d.symbol_key AND p.date = d.signal_date""", "deciding", "placed"))
def outcome_summary(spark, sf_dir):
    deciding = scored(spark, sf_dir).where("signal <> 'NO_DECISION'")
    return history.outcome_summary(history.resolved_outcomes(deciding, _listed_eod(spark, sf_dir), NOW))


@query("missing_eod_symbols", with_ctes("""
SELECT DISTINCT symbol_key FROM deciding WHERE symbol_key LIKE 'UPCOM-%'""", "deciding"))
def missing_eod_symbols(spark, sf_dir):
    deciding = scored(spark, sf_dir).where("signal <> 'NO_DECISION'")
    return history.missing_eod_symbols(history.resolved_outcomes(deciding, _listed_eod(spark, sf_dir), NOW))


@query("signal_current", with_ctes("""
SELECT symbol_key, max(signal_date) signal_date, max_by(signal, signal_date) signal FROM deciding GROUP BY symbol_key""", "deciding"))
def signal_current(spark, sf_dir):
    return history.current_signals(scored(spark, sf_dir).where("signal <> 'NO_DECISION'")).select(
        "symbol_key", "signal_date", "signal"
    )


@query("history_violations", with_ctes("""
SELECT sum(CASE WHEN symbol_key IS NULL THEN n ELSE 0 END)::bigint null_keys, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::bigint duplicate_keys,
  sum(bad)::bigint invalid_signals FROM (
  SELECT symbol_key, signal_date, count(*) n, sum(CASE WHEN s IN ('BULLISH','NEUTRAL','BEARISH','NO_DECISION') THEN 0 ELSE 1 END) bad FROM (
    SELECT symbol_key, signal_date, CASE WHEN score >= 4 THEN 'STRONG' ELSE signal END s FROM scored UNION ALL
    SELECT CASE WHEN score < 0 THEN NULL ELSE symbol_key END, signal_date, signal FROM scored WHERE signal = 'BEARISH' OR signal = 'NEUTRAL')
  GROUP BY symbol_key, signal_date)""", "scored"))
def history_violations(spark, sf_dir):
    rows = history.conform_history(scored(spark, sf_dir))
    odd = rows.withColumn("signal", F.when(F.col("score") >= 4, "STRONG").otherwise(F.col("signal")))
    repeated = rows.where("signal in ('BEARISH', 'NEUTRAL')").withColumn(
        "symbol_key", F.when(F.col("score") >= 0, F.col("symbol_key"))
    )
    return history.history_violations(odd.unionByName(repeated))


@query("conform_history", with_ctes("""
SELECT symbol_key, signal_date, signal, signal_price, CASE WHEN score > 1 THEN score ELSE 1 END::bigint revision FROM scored""", "scored"))
def conform_history(spark, sf_dir):
    """Legacy rows: lower-case signal, ``price`` column, revision as text."""
    legacy = scored(spark, sf_dir).select(
        "symbol_key", F.col("signal_date").cast("string").alias("signal_date"), F.lower("signal").alias("signal"),
        F.col("signal_price").alias("price"), F.col("score").cast("string").alias("revision"),
    )
    return history.conform_history(legacy).select(
        "symbol_key", "signal_date", "signal", "signal_price", big("revision")
    )
