"""Further indicators over daily bars: averages, bands, ranges, volume and trend measures.

Own definitions, each stated in one line; every value is null until its window is full.
All work on one partitioning by series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.ewm import block_sums, decayed_sums, in_blocks, leave_blocks
from marketlake.functions.numeric import gated_avg, rolling, safe_div
from marketlake.operators.indicators import with_ema

__all__ = ["with_directional", "with_moving_averages", "with_ranges", "with_volume_measures"]


def _w(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("date")


def _full(value: Column, frame, n: int, result: Column) -> Column:
    return F.when(F.count(value).over(frame) >= n, result)


def with_moving_averages(df: DataFrame, source: str = "ad_close", n: int = 20, keys: Sequence[str] = ("code",)) -> DataFrame:
    """``ema, dema, tema, wma, stddev, bb_upper, bb_middle, bb_lower`` over ``n`` rows.

    DEMA = 2 EMA - EMA(EMA); TEMA = 3 EMA - 3 EMA(EMA) + EMA(EMA(EMA)); WMA weighs linearly;
    STDDEV is the population deviation; the bands are two of it around the mean.
    """
    w, out, value = _w(keys), df, source
    for depth in ("_e1", "_e2", "_e3"):
        out = with_ema(out, value, [n], keys).withColumnRenamed(f"ema{n}", depth)
        value = depth
    frame, x = rolling(w, n), F.col(source)
    out = out.withColumn("_t", F.row_number().over(w))
    linear = F.sum(x * F.col("_t")).over(frame) - (F.col("_t") - n) * F.sum(x).over(frame)
    spread = F.stddev_pop(x).over(frame)
    return out.withColumns(
        {
            "ema": F.col("_e1"), "dema": F.col("_e1") * 2 - F.col("_e2"),
            "tema": (F.col("_e1") - F.col("_e2")) * 3 + F.col("_e3"),
            "wma": _full(x, frame, n, linear / (n * (n + 1) / 2)),
            "stddev": _full(x, frame, n, spread), "bb_middle": gated_avg(source, w, n),
            "bb_upper": _full(x, frame, n, F.avg(x).over(frame) + spread * 2),
            "bb_lower": _full(x, frame, n, F.avg(x).over(frame) - spread * 2),
        }
    ).drop("_e1", "_e2", "_e3", "_t")


def _true_range(w) -> Column:
    before = F.lag("ad_close").over(w)
    return F.greatest(F.col("ad_high") - F.col("ad_low"), F.abs(F.col("ad_high") - before), F.abs(F.col("ad_low") - before))


def with_ranges(df: DataFrame, n: int = 14, keys: Sequence[str] = ("code",)) -> DataFrame:
    """``atr`` (mean true range weighted by (1-1/n)^age), ``stoch_k`` / ``stoch_d`` (position of
    the close in the n-row range, and its 3-row mean), ``williams_r``, ``cci`` (distance of the
    typical price from its mean in units of 0.015 mean absolute deviations)."""
    w = _w(keys)
    frame, typical = rolling(w, n), (F.col("ad_high") + F.col("ad_low") + F.col("ad_close")) / 3
    out = df.withColumns({"_i": F.row_number().over(w) - 1, "_tr": _true_range(w), "_tp": typical})
    high, low = F.max("ad_high").over(frame), F.min("ad_low").over(frame)
    full = F.count("ad_close").over(frame) >= n
    mean = F.avg("_tp").over(frame)
    deviation = F.aggregate(F.collect_list("_tp").over(frame), F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m"))) / n
    out = out.withColumns(
        {
            "stoch_k": F.when(full, safe_div((F.col("ad_close") - low) * 100, high - low)),
            "williams_r": F.when(full, safe_div((high - F.col("ad_close")) * -100, high - low)),
            "_m": F.when(full, mean),
        }
    )
    out = out.withColumns(
        {"stoch_d": gated_avg("stoch_k", w, 3), "cci": safe_div(F.col("_tp") - F.col("_m"), deviation * 0.015)}
    )
    decay = 1.0 - 1.0 / n
    out = decayed_sums(out, keys, "_i", {"_s": (F.coalesce("_tr", F.lit(0.0)), decay), "_c": (F.lit(1.0), decay)})
    return out.withColumn("atr", F.when(F.col("_i") >= n - 1, safe_div("_s", "_c"))).drop(
        "_i", "_tr", "_tp", "_s", "_c", "_m"
    )


def with_volume_measures(df: DataFrame, n: int = 14, keys: Sequence[str] = ("code",)) -> DataFrame:
    """``obv`` (running volume signed by the change), ``vwap`` (n-row volume-weighted typical
    price), ``mfi`` (share of rising typical-price flow), ``cmf`` (volume weighted by the
    position of the close in the bar)."""
    w = _w(keys)
    frame, vol = rolling(w, n), F.col("nm_volume")
    typical = (F.col("ad_high") + F.col("ad_low") + F.col("ad_close")) / 3
    out = df.withColumns(
        {
            "_tp": typical, "_signed": F.signum(F.col("ad_close") - F.lag("ad_close").over(w)) * vol,
            "_move": typical - F.lag(typical).over(w),
            "_place": F.coalesce(safe_div(F.col("ad_close") * 2 - F.col("ad_low") - F.col("ad_high"), F.col("ad_high") - F.col("ad_low")), F.lit(0.0)),
        }
    )
    flow = F.col("_tp") * vol
    up, down = F.sum(F.when(F.col("_move") > 0, flow).otherwise(0.0)).over(frame), F.sum(F.when(F.col("_move") < 0, flow).otherwise(0.0)).over(frame)
    total = F.sum(vol).over(frame)
    full = F.count(vol).over(frame) >= n
    return out.withColumns(
        {
            "obv": F.sum(F.coalesce("_signed", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "vwap": F.when(full, safe_div(F.sum(flow).over(frame), total)),
            "mfi": F.when(F.count("_move").over(frame) >= n, safe_div(up * 100, up + down)),
            "cmf": F.when(full, safe_div(F.sum(F.col("_place") * vol).over(frame), total)),
        }
    ).drop("_tp", "_signed", "_move", "_place")


def with_directional(df: DataFrame, n: int = 14, keys: Sequence[str] = ("code",), aroon: int = 25) -> DataFrame:
    """``adx`` (mean of the directional index with weights (1-1/n)^age, after n rows of it) and
    ``aroon_up`` / ``aroon_down`` (100 * share of the last ``aroon`` rows since the extreme)."""
    w = _w(keys)
    up, down = F.col("ad_high") - F.lag("ad_high").over(w), F.lag("ad_low").over(w) - F.col("ad_low")
    decay = 1.0 - 1.0 / n
    out = df.withColumns(
        {
            "_i": F.row_number().over(w) - 1,
            "_p": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)),
            "_q": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
        }
    )
    frame = w.rowsBetween(-aroon, 0)
    full = F.count("ad_high").over(frame) > aroon

    def since(extreme: Column) -> Column:
        at = extreme.over(frame)
        return F.when(full, (F.lit(aroon) - (F.col("_i") - at)) * 100.0 / aroon)

    out = out.withColumns(
        {
            "aroon_up": since(F.max_by("_i", F.struct("ad_high", "_i"))),
            "aroon_down": since(F.max_by("_i", F.struct(-F.col("ad_low"), F.col("_i")))),
        }
    )
    out = block_sums(in_blocks(out, "_i"), keys, "_i", {"_sp": (F.col("_p"), decay), "_sq": (F.col("_q"), decay)})
    dx = safe_div(F.abs(F.col("_sp") - F.col("_sq")) * 100, F.col("_sp") + F.col("_sq"))
    out = out.withColumn("_dx", F.when(F.col("_i") >= n, dx))
    out = block_sums(out, keys, "_i", {
        "_sd": (F.coalesce("_dx", F.lit(0.0)), decay), "_sn": (F.col("_dx").isNotNull().cast("double"), decay)})
    return leave_blocks(out).withColumn("adx", F.when(F.col("_i") >= 2 * n - 1, safe_div("_sd", "_sn"))).drop("_i", "_p", "_q", "_sp", "_sq", "_dx", "_sd", "_sn")
