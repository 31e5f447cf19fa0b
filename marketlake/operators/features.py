"""Per-symbol session features: returns, MA20, volume ratio, forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from marketlake.functions.numeric import gated_avg, is_above, safe_div
from marketlake.functions.text import join_symbol_key
from marketlake.operators.normalize import normalize_eod

__all__ = ["FORWARD_WINDOWS", "RETURN_WINDOWS", "symbol_features"]

# Session offsets of the backward returns and of the forward labels.
RETURN_WINDOWS = (1, 5, 10, 20)
FORWARD_WINDOWS = (5, 10, 15, 20)


def symbol_features(eod: DataFrame, strict_ready: bool = False) -> DataFrame:
    """Features of every symbol at once.

    All windows share ``(exchange, symbol) ordered by date``: one shuffle and one sort for
    the lot, and a later join by (exchange, symbol) finds the rows already in place.
    ``normalize_eod`` has left one row per trading day, so a window partition is
    bounded by the calendar however many raw rows a symbol has. While MA20 is not ready
    ``above_ma20`` is false, or null with ``strict_ready``.
    """
    w = W.partitionBy("exchange", "symbol").orderBy("date")
    close = F.col("close")
    named = eod.withColumns({"exchange": F.upper("exchange"), "symbol": F.upper("code")})
    out = normalize_eod(named, keys=("exchange", "symbol")).withColumns(
        {
            "ma20": gated_avg("close", w, 20),
            "_volume_ma20": gated_avg("volume", w, 20),
            **{
                f"return_{n}d": safe_div(close, F.lag("close", n).over(w)) - 1.0
                for n in RETURN_WINDOWS
            },
            **{
                f"forward_return_t{n}": safe_div(F.lead("close", n).over(w), close) - 1.0
                for n in FORWARD_WINDOWS
            },
        }
    )
    above = is_above(close, "ma20")
    return out.select(
        "date",
        join_symbol_key(F.col("exchange"), F.col("symbol")).alias("symbol_key"),
        "exchange",
        "symbol",
        "close",
        "volume",
        *[f"return_{n}d" for n in RETURN_WINDOWS],
        "ma20",
        safe_div("volume", "_volume_ma20").alias("volume_ratio"),
        (above if strict_ready else F.coalesce(above, F.lit(False))).alias("above_ma20"),
        *[f"forward_return_t{n}" for n in FORWARD_WINDOWS],
    )
