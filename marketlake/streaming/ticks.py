"""Tick streams: duplicate-safe minute bars and trade intensity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlake.operators.intraday import bar_columns

__all__ = ["minute_bar_stream", "tick_intensity_stream"]


def minute_bar_stream(ticks: DataFrame, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Bars. In append mode each is emitted once, when the watermark has passed it; in update mode each
    batch emits the bars that it changed, so that the last state of each is the whole result.

    Trades are counted once per ``event_id`` within the lateness bound; later ones are dropped.
    """
    unique = ticks.withWatermark("market_timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy("symbol", F.window("market_timestamp", width).alias("w")).agg(*bar_columns()).select(
        "symbol", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume", "vwap", "trades"
    )


def tick_intensity_stream(ticks: DataFrame, width: str = "5 seconds", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Trades and volume per window; sliding when ``slide`` is given."""
    w = F.window("market_timestamp", width, slide) if slide else F.window("market_timestamp", width)
    return ticks.withWatermark("market_timestamp", lateness).groupBy("symbol", w.alias("w")).agg(
        F.count("*").alias("trades"), F.sum("volume").alias("volume")
    ).select("symbol", F.col("w.start").alias("window_start"), "trades", "volume")
