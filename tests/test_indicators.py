import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.functions.ewm import BLOCK, decayed_sums
from marketlake.operators import indicators as ind, oscillators as osc


def bars(spark, n, code="A", start=dt.date(2020, 1, 1)):
    rows = [(code, start + dt.timedelta(days=i), float(i + 1), float(i + 2), float(i), float(i + 1), 1000.0) for i in range(n)]
    return spark.createDataFrame(rows, "code string, date date, ad_open double, ad_high double, ad_low double, ad_close double, nm_volume double")


def values(df, name):
    return [r[name] for r in df.orderBy("date").select(name).collect()]


def test_moving_average_gate(spark):
    out = ind.indicators(bars(spark, 60), ["MA20", "MA50"])
    ma20, ma50 = values(out, "ma20"), values(out, "ma50")
    assert ma20[18] is None and ma20[19] == 10.5
    assert ma50[48] is None and ma50[49] == 25.5


def test_ichimoku_golden(spark):
    out = ind.indicators(bars(spark, 80), ["ICHIMOKU"]).cache()
    assert values(out, "ichimoku_tenkan")[8] == 5.0
    assert values(out, "ichimoku_span_a")[77] == 43.75
    assert values(out, "ichimoku_span_b")[77] == 26.5
    chikou = values(out, "ichimoku_chikou")
    assert chikou[0] == 27 and chikou[53] == 80 and chikou[54:] == [None] * 26


def test_ichimoku_short_series_keeps_shape(spark):
    out = ind.indicators(bars(spark, 40), ["ICHIMOKU"])
    assert out.count() == 40
    assert set(values(out, "ichimoku_span_b")) == {None}


def test_unknown_indicator_is_refused(spark):
    with pytest.raises(ValueError):
        ind.indicators(bars(spark, 3), ["EMA9"])
    with pytest.raises(ValueError):
        ind.indicators(bars(spark, 3), [])


@pytest.mark.parametrize("decay", [13 / 14, 25 / 27, 11 / 13, 0.8])
def test_decayed_sums_equal_the_recursion_over_many_blocks(spark, decay):
    n = BLOCK * 12 + 17
    x = np.random.default_rng(7).normal(100, 30, n)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(n), "x": x}))
    got = decayed_sums(df, ["k"], "i", {"y": (F.col("x"), decay)}).orderBy("i").toPandas()["y"].to_numpy()
    want, acc = np.empty(n), 0.0
    for i in range(n):
        acc = x[i] + decay * acc
        want[i] = acc
    assert np.allclose(got, want, rtol=1e-12)


def test_rsi_and_macd_match_pandas(spark):
    n = 900
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    dates = pd.date_range("2015-01-01", periods=n).date
    pdf = pd.DataFrame({"code": "A", "date": dates, "ad_close": close})
    out = ind.indicators(spark.createDataFrame(pdf), ["RSI14", "MACD"]).orderBy("date").toPandas()

    change = pd.Series(close).diff()
    gain = change.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean()
    loss = (-change.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14).mean()
    rsi = 100 * gain / (gain + loss)
    assert np.allclose(out["rsi14"].to_numpy(float), rsi.to_numpy(), equal_nan=True)

    def ema(s, span):
        s = s.copy()
        first = s.first_valid_index()
        seed = first + span - 1
        mean = s.iloc[first:seed + 1].mean()
        s.iloc[:seed] = np.nan
        s.iloc[seed] = mean
        return s.ewm(span=span, adjust=False).mean()

    line = ema(pd.Series(close), 12) - ema(pd.Series(close), 26)
    signal = ema(line, 9)
    assert out["macd"].first_valid_index() == 25 and out["macd_signal"].first_valid_index() == 33
    assert np.allclose(out["macd"].to_numpy(float), line.to_numpy(), equal_nan=True)
    assert np.allclose(out["macd_signal"].to_numpy(float), signal.to_numpy(), equal_nan=True)


def test_null_source_rows_stay_out_of_the_series(spark):
    df = bars(spark, 60).withColumn("ad_close", F.when(F.dayofmonth("date") != 5, F.col("ad_close")))
    out = ind.with_rsi(df, "ad_close").orderBy("date").collect()
    assert all(r.rsi14 is None for r in out if r.date.day == 5)
    known = [r.rsi14 for r in out if r.rsi14 is not None]
    assert known and set(known) == {100.0}


def test_flat_series_has_no_rsi(spark):
    df = bars(spark, 30).withColumn("ad_close", F.lit(5.0))
    assert set(values(ind.with_rsi(df, "ad_close"), "rsi14")) == {None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("names", [["MACD"], ["MA20", "MA50", "RSI14", "MACD"], ["RSI14", "MACD", "MA20", "ICHIMOKU"]])
def test_indicators_sort_a_series_twice(spark, names):
    """Each sort of a stage adds to what its tasks hold: one by date, one by block for all decayed sums."""
    assert plan_of(ind.indicators(bars(spark, 60), names)).count(" Sort [") == 2


@pytest.mark.parametrize("measure", [osc.with_ranges, osc.with_directional])
def test_oscillators_sort_a_series_twice(spark, measure):
    assert plan_of(measure(bars(spark, 60))).count(" Sort [") == 2


def test_macd_alone_and_beside_others_with_gaps(spark):
    """Rows without a value stay out of the sums, over several blocks, whatever else is asked for."""
    df = bars(spark, 700).withColumn("ad_close", F.when(F.dayofmonth("date") % 7 != 5, F.col("ad_close") % 97 + 50))
    both = ind.indicators(df, ["RSI14", "MACD", "MA20"]).orderBy("date").toPandas()
    alone = ind.with_macd(df, "ad_close").orderBy("date").toPandas()
    kept = alone["ad_close"].notna()
    series = ind.with_macd(df.dropna(subset=["ad_close"]), "ad_close").orderBy("date").toPandas()
    for c in ("macd", "macd_signal", "macd_hist"):
        assert alone[c].equals(both[c]) and alone.loc[~kept, c].isna().all()
        assert np.allclose(alone.loc[kept, c].to_numpy(float), series[c].to_numpy(float), rtol=1e-12, equal_nan=True)
    rsi = ind.with_rsi(df, "ad_close").orderBy("date").toPandas()["rsi14"]
    assert rsi.equals(both["rsi14"]) and rsi.notna().sum() == kept.sum() - 14
