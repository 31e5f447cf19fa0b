"""Trend-momentum scoring rules and the no-decision cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import keep_last
from marketlake.functions.numeric import is_above

__all__ = [
    "STRATEGY", "deciding_changes", "latest_only", "latest_signals", "missing_column_reasons", "reason_codes", "score", "score_rows",
    "scored_history",
]

# The strategy name, its thresholds and its inputs.
STRATEGY = "TREND_MOMENTUM_V1"
BULLISH_FROM = 3
BEARISH_TO = -3
RSI_HIGH = 55
RSI_LOW = 45
EOD_COLUMNS = ("date", "ad_close")
INDICATOR_COLUMNS = ("date", "ma20", "ma50", "rsi14", "macd", "macd_signal")
SCORED_VALUES = ("ad_close", "ma20", "ma50", "rsi14", "macd", "macd_signal")


def _side(a: str | Column, b: str | Column, weight: int) -> Column:
    """+weight above, -weight below, 0 when equal but for rounding."""
    return F.when(is_above(a, b), weight).when(is_above(b, a), -weight).otherwise(0)


def _rsi_side() -> Column:
    return F.when(F.col("rsi14") > RSI_HIGH, 1).when(F.col("rsi14") < RSI_LOW, -1).otherwise(0)


def score() -> Column:
    return (
        _side("ad_close", "ma50", 2) + _side("ma20", "ma50", 1) + _rsi_side() + _side("macd", "macd_signal", 1)
    ).cast("int")


def _named(side: Column, above: str, below: str, even: str) -> Column:
    return F.when(side > 0, above).when(side < 0, below).otherwise(even)


def reason_codes(points: Column) -> Column:
    """One code per rule in rule order, then the score."""
    return F.array(
        _named(_side("ad_close", "ma50", 2), "PRICE_ABOVE_MA50", "PRICE_BELOW_MA50", "PRICE_EQUALS_MA50"),
        _named(_side("ma20", "ma50", 1), "MA20_ABOVE_MA50", "MA20_BELOW_MA50", "MA20_EQUALS_MA50"),
        _named(_rsi_side(), "RSI14_ABOVE_55", "RSI14_BELOW_45", "RSI14_NEUTRAL"),
        _named(_side("macd", "macd_signal", 1), "MACD_ABOVE_SIGNAL", "MACD_BELOW_SIGNAL", "MACD_EQUALS_SIGNAL"),
        F.concat(F.lit("SCORE_"), points.cast("string")),
    )


def _missing_values() -> Column:
    codes = [F.when(F.col(c).isNull(), F.lit(f"MISSING_VALUE_{c.upper()}")) for c in SCORED_VALUES]
    return F.array_compact(F.array(*codes))


def missing_column_reasons(eod: DataFrame, indicators: DataFrame) -> list[str]:
    """Reason codes when whole columns are absent (checked on the schemas, no job)."""
    return [f"MISSING_EOD_COLUMN_{c.upper()}" for c in sorted(set(EOD_COLUMNS) - set(eod.columns))] + [
        f"MISSING_INDICATOR_COLUMN_{c.upper()}" for c in sorted(set(INDICATOR_COLUMNS) - set(indicators.columns))
    ]


def _scored(rows: DataFrame, key: str) -> DataFrame:
    missing = _missing_values()
    points = score()
    complete = F.size("_missing") == 0
    signal = (
        F.when(~complete, "NO_DECISION")
        .when(F.col("score") >= BULLISH_FROM, "BULLISH")
        .when(F.col("score") <= BEARISH_TO, "BEARISH")
        .otherwise("NEUTRAL")
    )
    rows = rows.withColumn("_missing", missing).withColumn("score", F.when(complete, points).otherwise(0))
    return rows.select(
        key,
        F.col("date").alias("signal_date"),
        signal.alias("signal"),
        F.col("ad_close").alias("signal_price"),
        "score",
        F.when(complete, reason_codes(F.col("score"))).otherwise(F.col("_missing")).alias("reason_codes"),
    )


def score_rows(rows: DataFrame, key: str = "symbol_key") -> DataFrame:
    """The rule on rows that carry close and indicators side by side (no join needed)."""
    return _scored(rows.select(key, *EOD_COLUMNS, *INDICATOR_COLUMNS[1:]), key)


def _one_a_day(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The last delivered row per key and date: by ``_seq`` where rows carry it, equal ones by their values."""
    order = ["_seq"] if "_seq" in df.columns else []
    values = [c for c in columns if c != "date"]
    return keep_last(df.select(key, *columns, *order), [key, "date"], [*order, *values]).select(key, *columns)


def scored_history(eod: DataFrame, indicators: DataFrame, key: str = "symbol_key") -> DataFrame:
    """The rule on every date two stored inputs share."""
    joined = _one_a_day(eod, key, EOD_COLUMNS).join(_one_a_day(indicators, key, INDICATOR_COLUMNS), [key, "date"])
    return _scored(joined, key)


def latest_signals(
    eod: DataFrame, indicators: DataFrame, symbols: DataFrame | None = None, key: str = "symbol_key",
) -> DataFrame:
    """The rule on the latest shared date of each symbol.

    With ``symbols`` every listed symbol gets a row: no shared date gives NO_DECISION.
    Absent columns give NO_DECISION for every symbol of ``symbols`` (or of the EOD rows).
    """
    reasons = missing_column_reasons(eod, indicators)
    if reasons:
        keys = (symbols if symbols is not None else eod).select(key).distinct()
        return _no_decision(keys, F.array(*[F.lit(r) for r in reasons]), key)
    joined = _one_a_day(eod, key, EOD_COLUMNS).join(_one_a_day(indicators, key, INDICATOR_COLUMNS), [key, "date"])
    latest = _scored(keep_last(joined, [key], ["date"]), key)
    if symbols is None:
        return latest
    rows = latest.join(symbols.select(key).distinct(), key, "full_outer")
    absent = F.array(F.lit("NO_OVERLAPPING_EOD_INDICATOR_DATES"))
    return rows.withColumns(
        {
            "signal": F.coalesce("signal", F.lit("NO_DECISION")), "score": F.coalesce("score", F.lit(0)),
            "reason_codes": F.coalesce("reason_codes", absent),
        }
    )


def _no_decision(keys: DataFrame, reasons: Column, key: str) -> DataFrame:
    return keys.select(
        key, F.lit(None).cast("date").alias("signal_date"), F.lit("NO_DECISION").alias("signal"),
        F.lit(None).cast("double").alias("signal_price"), F.lit(0).alias("score"), reasons.alias("reason_codes"),
    )


def latest_only(history: DataFrame, key: str = "symbol_key") -> DataFrame:
    """The most recent row per symbol."""
    return keep_last(history, [key], ["signal_date"])


def deciding_changes(history: DataFrame, key: str = "symbol_key") -> DataFrame:
    """Previous deciding signal along a full history; changed when it exists and differs."""
    w = W.partitionBy(key).orderBy("signal_date")
    out = history.where("signal <> 'NO_DECISION'").withColumn("previous_signal", F.lag("signal").over(w))
    changed = F.coalesce(F.col("previous_signal") != F.col("signal"), F.lit(False))
    return out.withColumn("signal_changed", changed)
