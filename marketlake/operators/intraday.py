"""Intraday bars, features, sector aggregates and checks.

The definitions here are our own; each docstring states its formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.numeric import safe_div

__all__ = [
    "bar_columns", "coarser_bars", "intraday_features", "intraday_sectors", "reconcile_bars",
    "tick_intensity", "trade_bars", "validated_trades",
]

BAR = ["open", "high", "low", "close", "volume", "vwap", "trades"]


def bar_columns() -> list[Column]:
    """OHLCV, VWAP and trade count of a group of ticks, ordered by time and event id."""
    at = F.struct("market_timestamp", "event_id")
    return [
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
        safe_div(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), F.count("*").alias("trades"),
    ]


def trade_bars(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """Bars of ``minutes`` from ticks; all parts combine on the map side."""
    w = F.window("market_timestamp", f"{minutes} minutes")
    return ticks.groupBy("symbol", w.alias("w")).agg(*bar_columns()).select(
        "symbol", F.col("w.start").alias("bar_time"), *BAR
    )


def coarser_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """5 or 15 minute bars from 1 minute bars; VWAP is weighted by volume."""
    w = F.window("bar_time", f"{minutes} minutes")
    return bars.groupBy("symbol", w.alias("w")).agg(
        F.min_by("open", "bar_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_time").alias("close"), F.sum("volume").alias("volume"),
        safe_div(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap"), F.sum("trades").alias("trades"),
    ).select("symbol", F.col("w.start").alias("bar_time"), *BAR)


def intraday_features(bars: DataFrame, opening_minutes: int = 30) -> DataFrame:
    """Per bar of a session (calendar day): return to the previous bar, return from the
    session open, distance to the running session VWAP, cumulative volume, realised
    volatility (root of the sum of squared bar returns so far) and the high-low range of the
    first ``opening_minutes``. A window partition is one symbol's session: bounded by the
    number of bars in a day."""
    session = bars.withColumn("session", F.to_date("bar_time"))
    w = W.partitionBy("symbol", "session").orderBy("bar_time")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("symbol", "session")
    close = F.col("close")
    out = session.withColumns(
        {
            "bar_return": safe_div(close, F.lag("close").over(w)) - 1.0,
            "session_open": F.first("open").over(so_far),
            "session_volume": F.sum("volume").over(so_far),
            "session_vwap": safe_div(F.sum(F.col("vwap") * F.col("volume")).over(so_far), F.sum("volume").over(so_far)),
            "_start": F.min("bar_time").over(whole),
        }
    )
    opening = F.unix_seconds("bar_time") < F.unix_seconds("_start") + opening_minutes * 60
    out = out.withColumns(
        {
            "return_from_open": safe_div(close, F.col("session_open")) - 1.0,
            "vwap_distance": safe_div(close, F.col("session_vwap")) - 1.0,
            "realized_volatility": F.sqrt(F.sum(F.coalesce("bar_return", F.lit(0.0)) ** 2).over(so_far)),
            "opening_range": F.max(F.when(opening, F.col("high"))).over(whole) - F.min(F.when(opening, F.col("low"))).over(whole),
        }
    )
    return out.drop("_start")


def intraday_sectors(features: DataFrame, members: DataFrame) -> DataFrame:
    """Per sector and bar: share of rising members, volume relative to the sector's session
    mean so far, leading and lagging member by return from open (ties: smaller symbol)."""
    ret = F.col("return_from_open")
    bars = features.join(members.select("symbol", "sector_code"), "symbol").groupBy("sector_code", "session", "bar_time").agg(
        F.count("*").alias("members"), F.avg((ret > 0).cast("double")).alias("breadth"), F.sum("volume").alias("volume"),
        F.min_by("symbol", F.struct(-ret, "symbol")).alias("leader"), F.min_by("symbol", F.struct(ret, "symbol")).alias("laggard"),
    )
    so_far = W.partitionBy("sector_code", "session").orderBy("bar_time").rowsBetween(W.unboundedPreceding, 0)
    return bars.withColumn("relative_volume", safe_div(F.col("volume"), F.avg("volume").over(so_far)))


def tick_intensity(ticks: DataFrame, seconds: int = 5) -> DataFrame:
    """Trades per window of ``seconds``, its z-score over the 20 windows before, and the
    return to the last window: null z-score while fewer than 20 are known or all are equal.

    Windows without trades have no row. The frame runs over windows, after the reduction.
    """
    w = F.window("market_timestamp", f"{seconds} seconds")
    at = F.struct("market_timestamp", "event_id")
    counted = ticks.groupBy("symbol", w.alias("w")).agg(
        F.count("*").alias("trades"), F.sum("volume").alias("volume"), F.max_by("price", at).alias("last_price")
    ).select("symbol", F.col("w.start").alias("window_start"), "trades", "volume", "last_price")
    # a session per window partition keeps it bounded by the seconds of a day
    series = W.partitionBy("symbol", "session").orderBy("window_start")
    before = series.rowsBetween(-20, -1)
    z = safe_div(F.col("trades") - F.avg("trades").over(before), F.stddev_samp("trades").over(before))
    return counted.withColumn("session", F.to_date("window_start")).withColumns(
        {
            "intensity_z": F.when(F.count("trades").over(before) >= 20, z),
            "window_return": safe_div("last_price", F.lag("last_price").over(series)) - 1.0,
        }
    )


def reconcile_bars(stream: DataFrame, batch: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stream bars against batch bars: MATCH, MISSING_IN_STREAM, MISSING_IN_BATCH or DIFFERENT."""
    keys = ["symbol", "bar_time"]
    both = stream.select(*keys, *BAR).alias("s").join(batch.select(*keys, *BAR).alias("b"), keys, "full_outer")
    far = F.lit(False)
    for c in BAR:
        far = far | (F.abs(F.col(f"s.{c}") - F.col(f"b.{c}")) > tolerance)
    verdict = (
        F.when(F.col("s.trades").isNull(), "MISSING_IN_STREAM").when(F.col("b.trades").isNull(), "MISSING_IN_BATCH")
        .when(far, "DIFFERENT").otherwise("MATCH")
    )
    return both.select(*keys, verdict.alias("verdict"), F.col("s.volume").alias("stream_volume"), F.col("b.volume").alias("batch_volume"))


def validated_trades(ticks: DataFrame, open_hour: int = 2, close_hour: int = 8) -> DataFrame:
    """Add a stable identity (hash of symbol, time, price, volume and event id) and the rules a
    trade breaks: outside the session hours, price or volume not above zero."""
    hour = F.hour("market_timestamp")
    rules = [
        ((hour < open_hour) | (hour >= close_hour), "OUTSIDE_SESSION"),
        (F.coalesce(F.col("price") <= 0, F.lit(True)), "PRICE"),
        (F.coalesce(F.col("volume") <= 0, F.lit(True)), "VOLUME"),
    ]
    identity = F.sha2(F.concat_ws("|", "symbol", F.unix_micros("market_timestamp"), "price", "volume", "event_id"), 256)
    return ticks.withColumns(
        {"trade_id": identity, "violations": F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))}
    )
