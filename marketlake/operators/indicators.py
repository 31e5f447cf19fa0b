"""Technical indicators over daily bars: MA, RSI, MACD, Ichimoku."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

from marketlake.functions.ewm import along, block_sums, decayed_sums, in_blocks, leave_blocks
from marketlake.functions.numeric import gated_avg, rolling, safe_div

__all__ = [
    "INDICATOR_COLUMNS", "indicators", "with_ema", "with_ichimoku", "with_ma", "with_macd", "with_rsi",
]

# Indicator names and the columns each one adds.
INDICATOR_COLUMNS = {
    "MA20": ["ma20"],
    "MA50": ["ma50"],
    "RSI14": ["rsi14"],
    "MACD": ["macd", "macd_signal", "macd_hist"],
    "ICHIMOKU": [
        "ichimoku_tenkan", "ichimoku_kijun", "ichimoku_span_a", "ichimoku_span_b", "ichimoku_chikou",
    ],
}


def _series(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("date")


def _index(value: Column, w: WindowSpec) -> Column:
    """Position among the non-null values of a series, from 0; null where the value is null."""
    seen = F.count(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.when(value.isNotNull(), seen - 1)


def with_ma(df: DataFrame, source: str, length: int, keys: Sequence[str] = ("code",)) -> DataFrame:
    return df.withColumn(f"ma{length}", gated_avg(source, _series(keys), length))


def with_rsi(df: DataFrame, source: str, keys: Sequence[str] = ("code",), length: int = 14) -> DataFrame:
    """Relative strength index with weight 1/length, null until ``length`` changes are known.

    Gains and losses are decayed with the same weights, so their normaliser cancels and the
    plain decayed sums suffice. A series without any move has no defined value: null.
    Rows with a null source are left out of the series and get null.
    """
    return _with_decayed(df, source, keys, rsi=length)


def _ema_input(value: Column, index: str, mean: Column, span: int, first: int = 0) -> Column:
    """EMA written as a decayed sum: nothing before the seed, the simple mean of the first
    ``span`` values as the seed, then ``alpha * x``."""
    seed_at = first + span - 1
    return (
        F.when(F.col(index) < seed_at, 0.0)
        .when(F.col(index) == seed_at, mean)
        .otherwise(value * (2.0 / (span + 1)))
    )


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1)


def with_ema(df: DataFrame, source: str, spans: Sequence[int], keys: Sequence[str] = ("code",)) -> DataFrame:
    """``ema{span}`` columns, seeded with the mean of the first ``span`` values."""
    w = _series(keys)
    value = F.col(source)
    running = F.avg(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumns({"_ei": _index(value, w), "_em": running})
    out = decayed_sums(
        out, keys, "_ei",
        {f"ema{n}": (_ema_input(value, "_ei", F.col("_em"), n), _decay(n)) for n in spans},
    )
    ready = {f"ema{n}": F.when(F.col("_ei") >= n - 1, F.col(f"ema{n}")) for n in spans}
    return out.withColumns(ready).drop("_ei", "_em")


def with_macd(
    df: DataFrame, source: str, keys: Sequence[str] = ("code",),
    fast: int = 12, slow: int = 26, signal: int = 9,
) -> DataFrame:
    """MACD line, its signal (EMA of the line from its first value) and the histogram."""
    return _with_decayed(df, source, keys, macd=(fast, slow, signal))


def _with_decayed(
    df: DataFrame, source: str, keys: Sequence[str], rsi: int | None = None, macd: tuple[int, int, int] | None = None,
) -> DataFrame:
    """RSI, MACD or both along one index: their sums share one sort, the line's signal included.

    The line starts where the slower EMA does, so its own index is that of the source less a constant.
    """
    w = _series(keys)
    value, i = F.col(source), F.col("_i")
    before, terms = {"_i": _index(value, w)}, {}
    if rsi:
        prior = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        before["_chg"] = F.coalesce(value - prior, F.lit(0.0))
        decay = 1.0 - 1.0 / rsi
        terms["_gain"] = (F.greatest("_chg", F.lit(0.0)), decay)
        terms["_loss"] = (F.greatest(-F.col("_chg"), F.lit(0.0)), decay)
    if macd:
        fast, slow, signal = macd
        first = max(fast, slow) - 1
        before["_m"] = F.avg(value).over(w.rowsBetween(W.unboundedPreceding, 0))
        terms |= {name: (_ema_input(value, "_i", F.col("_m"), n), _decay(n)) for name, n in (("_fast", fast), ("_slow", slow))}
    out = block_sums(in_blocks(df.withColumns(before), "_i"), keys, "_i", terms)
    if rsi:
        out = out.withColumn(f"rsi{rsi}", F.when(i >= rsi, safe_div("_gain", F.col("_gain") + F.col("_loss")) * 100.0))
    if macd:
        line = F.col("macd")
        out = out.withColumn("macd", F.when(i >= first, F.col("_fast") - F.col("_slow")))
        out = out.withColumn("_m", F.avg(line).over(along(keys).rowsBetween(W.unboundedPreceding, 0)))
        out = block_sums(out, keys, "_i", {"_signal": (_ema_input(line, "_i", F.col("_m"), signal, first), _decay(signal))})
        out = out.withColumn("macd_signal", F.when(i >= first + signal - 1, F.col("_signal")))
        out = out.withColumn("macd_hist", line - F.col("macd_signal"))
    return leave_blocks(out).drop("_i", "_chg", "_m", "_gain", "_loss", "_fast", "_slow", "_signal")


def with_ichimoku(
    df: DataFrame, source: str, keys: Sequence[str] = ("code",),
    tenkan: int = 9, kijun: int = 26, senkou: int = 52,
) -> DataFrame:
    """Ichimoku lines at the shape of the input; series shorter than ``senkou`` get nulls.

    The chikou line looks ahead: it is for charts only, never for a signal.
    """
    w = _series(keys)

    def middle(n: int) -> Column:
        frame = rolling(w, n)
        full = (F.count("ad_high").over(frame) >= n) & (F.count("ad_low").over(frame) >= n)
        return F.when(full, (F.max("ad_high").over(frame) + F.min("ad_low").over(frame)) / 2.0)

    out = df.withColumns(
        {
            "ichimoku_tenkan": middle(tenkan), "ichimoku_kijun": middle(kijun), "_b": middle(senkou),
            "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
            "ichimoku_chikou": F.lead(source, kijun).over(w),
        }
    )
    mean = (F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2.0
    out = out.withColumns(
        {"ichimoku_span_a": F.lag(mean, kijun).over(w), "ichimoku_span_b": F.lag("_b", kijun).over(w)}
    )
    gate = {c: F.when(F.col("_n") >= senkou, F.col(c)) for c in INDICATOR_COLUMNS["ICHIMOKU"]}
    return out.withColumns(gate).drop("_b", "_n")


def indicators(
    eod: DataFrame, requested: Sequence[str], source: str = "ad_close", keys: Sequence[str] = ("code",),
    calculated_at: datetime | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """The requested indicators for every series, one row per prepared bar.

    Everything is computed on one partitioning by series key and Spark prunes what the
    request leaves out. Windows by date come first, then the decayed sums: two sorts for all. ``calculated_at`` adds the usual ``*_calculated_at`` columns;
    ``keep`` carries bar columns along, which saves a later join with the same bars.
    """
    names = [n.upper() for n in requested]
    unknown = sorted(set(names) - set(INDICATOR_COLUMNS))
    if not names or unknown:
        raise ValueError(f"supported indicators: {', '.join(INDICATOR_COLUMNS)}; got {list(requested)}")
    out = eod
    for name in dict.fromkeys(names):
        if name in ("MA20", "MA50"):
            out = with_ma(out, source, int(name[2:]), keys)
        elif name == "ICHIMOKU":
            out = with_ichimoku(out, source, keys)
    if {"RSI14", "MACD"} & set(names):
        out = _with_decayed(out, source, keys, 14 if "RSI14" in names else None, (12, 26, 9) if "MACD" in names else None)
    columns = [*keys, "date", *keep]
    for name in dict.fromkeys(names):
        columns += INDICATOR_COLUMNS[name]
        if calculated_at is not None:
            stamp = f"{name.lower()}_calculated_at"
            out = out.withColumn(stamp, F.lit(calculated_at))
            columns.append(stamp)
    return out.select(*columns)
