import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlake.operators import features, history as hist, indicators, signals

D0 = dt.date(2026, 1, 1)
NOW = dt.datetime(2026, 6, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def inputs(spark, close=120.0, ma20=110.0, ma50=100.0, rsi=60.0, macd=2.0, macd_signal=1.0):
    eod = spark.createDataFrame([("X-A", day(0), 20.0), ("X-A", day(1), close)], "symbol_key string, date date, ad_close double")
    ind = spark.createDataFrame(
        [("X-A", day(1), ma20, ma50, rsi, macd, macd_signal)],
        "symbol_key string, date date, ma20 double, ma50 double, rsi14 double, macd double, macd_signal double",
    )
    return eod, ind


@pytest.mark.parametrize(
    "kw, signal, score",
    [
        ({}, "BULLISH", 5), ({"close": 90.0, "ma20": 95.0, "rsi": 40.0, "macd": 0.5}, "BEARISH", -5),
        ({"close": 100.0, "ma20": 100.0, "rsi": 50.0, "macd": 1.0}, "NEUTRAL", 0), ({"ma20": 90.0, "rsi": 55.0}, "NEUTRAL", 2),
    ],
)
def test_rules(spark, kw, signal, score):
    row = signals.latest_signals(*inputs(spark, **kw)).first()
    assert (row.signal, row.score, row.reason_codes[-1]) == (signal, score, f"SCORE_{score}")


def test_equal_reasons(spark):
    row = signals.latest_signals(*inputs(spark, close=100.0, ma20=100.0, rsi=50.0, macd=1.0)).first()
    assert row.reason_codes == ["PRICE_EQUALS_MA50", "MA20_EQUALS_MA50", "RSI14_NEUTRAL", "MACD_EQUALS_SIGNAL", "SCORE_0"]


#: Ten closes, the last one their mean: over and over, MA20, MA50 and every tenth close are one value.
TEN = [1073.74, 1014.3, 1021.47, 1089.84, 1041.21, 1010.07, 1034.14, 1070.57, 1055.33, 1045.63]


def tied_bars(spark):
    assert sum(round(c * 100) for c in TEN) == 10 * round(100 * TEN[-1])
    rows = [("X", "A", day(i), c, 1.0) for i, c in enumerate(TEN * 6)]
    return spark.createDataFrame(rows, "exchange string, code string, date date, ad_close double, nm_volume double")


def test_equal_means_of_two_windows_are_equal(spark):
    bars = tied_bars(spark).withColumn("symbol_key", F.lit("X-A"))
    table = indicators.indicators(bars, ["MA20", "MA50", "RSI14", "MACD"], keys=("symbol_key",), keep=["ad_close"])
    got = signals.score_rows(table).where(F.col("signal_date") == day(59)).first()
    assert got.reason_codes[:2] == ["PRICE_EQUALS_MA50", "MA20_EQUALS_MA50"]


def test_no_decision_cases(spark):
    eod, ind = inputs(spark, rsi=None)
    row = signals.latest_signals(eod, ind).first()
    assert (row.signal, row.signal_price, row.score, row.reason_codes) == ("NO_DECISION", 120.0, 0, ["MISSING_VALUE_RSI14"])
    row = signals.latest_signals(eod, ind.drop("macd", "ma20")).first()
    assert row.reason_codes == ["MISSING_INDICATOR_COLUMN_MA20", "MISSING_INDICATOR_COLUMN_MACD"]
    listed = spark.createDataFrame([("X-A",), ("X-B",)], "symbol_key string")
    rows = {r.symbol_key: r for r in signals.latest_signals(eod, ind, listed).collect()}
    assert rows["X-B"].reason_codes == ["NO_OVERLAPPING_EOD_INDICATOR_DATES"]


def test_listed_symbols_cost_no_second_pass(spark):
    """The signals are computed once, also where symbols without one get a row; a symbol that is not listed keeps its own."""
    eod, ind = inputs(spark)
    listed = spark.createDataFrame([("X-B",), ("X-B",), (None,)], "symbol_key string")
    both = signals.latest_signals(eod, ind, listed)
    windows = [df._jdf.queryExecution().optimizedPlan().toString().count("Window [") for df in (signals.latest_signals(eod, ind), both)]
    assert windows[0] == windows[1] > 0
    rows = {r.symbol_key: r for r in both.collect()}
    assert both.count() == 3 and rows["X-A"].signal != "NO_DECISION" and rows["X-A"].reason_codes[-1].startswith("SCORE_")
    for key in ("X-B", None):
        assert (rows[key].signal, rows[key].score, rows[key].signal_date, rows[key].signal_price) == ("NO_DECISION", 0, None, None)


def record(spark, rows):
    base = spark.createDataFrame(rows, "symbol_key string, signal_date date, signal string, signal_price double")
    return base.withColumns({"exchange": F.lit("X"), "strategy": F.lit("S"), "timeframe": F.lit("1d"), "score": F.lit(0)})


def prices(spark, n=25, key="X-A"):
    return spark.createDataFrame([(key, day(i), 100.0 + i) for i in range(n)], "symbol_key string, date date, ad_close double")


def test_outcomes_golden(spark):
    out = hist.fill_outcomes(record(spark, [("X-A", day(0), "BULLISH", 100.0)]), prices(spark), NOW).first()
    assert [out[f"actual_price_t{n}"] for n in (5, 10, 15, 20)] == [105.0, 110.0, 115.0, 120.0]
    assert out.actual_return_t10 == pytest.approx(0.1)
    assert out.actual_updated_at == NOW


def test_outcomes_on_dirty_prices(spark):
    rows = [("X-A", "2026-01-03", 100.0, 0)] + [("X-A", f"2026-01-0{d}", 97.0 + d, d) for d in (4, 5, 6, 7)]
    rows += [("X-A", "bad-date", 1.0, 8), ("X-A", "2026-01-08", None, 9), ("X-A", "2026-01-09", 1.0, 10), ("X-A", "2026-01-09", 106.0, 11)]
    eod = spark.createDataFrame(rows, "symbol_key string, date string, ad_close double, _seq int")
    out = hist.fill_outcomes(record(spark, [("X-A", day(2), "BULLISH", 100.0)]), eod, NOW, order=("_seq",)).first()
    assert out.actual_price_t5 == 106.0


def test_signal_between_sessions(spark):
    weekend = prices(spark).where("dayofmonth(date) not in (3, 4)")
    out = hist.fill_outcomes(record(spark, [("X-A", day(2), "BULLISH", 100.0), ("X-A", day(3), "BULLISH", 100.0)]), weekend, NOW).collect()
    assert {r.actual_price_t5 for r in out} == {108.0}


def test_outcomes_leave_the_rest_alone(spark):
    rows = record(spark, [("X-A", day(0), "BULLISH", 0.0), ("X-A", day(1), "NO_DECISION", 100.0), ("X-B", day(0), "BULLISH", 100.0), ("X-A", day(2), "BEARISH", None)])
    out = hist.fill_outcomes(rows, prices(spark), NOW)
    assert out.where("actual_updated_at is not null").count() == 0
    filled = record(spark, [("X-A", day(0), "BULLISH", 100.0)]).withColumns({"actual_price_t5": F.lit(1.0), "actual_return_t5": F.lit(2.0)})
    row = hist.fill_outcomes(filled, prices(spark), NOW).first()
    assert (row.actual_price_t5, row.actual_return_t5, row.actual_price_t10) == (1.0, 2.0, 110.0)


def test_outcome_summary(spark):
    before = record(spark, [("X-A", day(0), "BULLISH", 100.0), ("X-B", day(0), "BULLISH", 100.0), ("X-C", day(0), "NO_DECISION", 1.0)])
    resolved = hist.resolved_outcomes(before, prices(spark), NOW)
    row = hist.outcome_summary(resolved).first()
    assert (row.records_scanned, row.records_updated, row.missing_eod_count) == (3, 1, 1)
    assert [r.symbol_key for r in hist.missing_eod_symbols(resolved).collect()] == ["X-B"]


def test_upsert_keeps_outcomes_and_counts_revisions(spark):
    old = record(spark, [("X-A", day(0), "bearish", 100.0), ("X-A", day(1), "NEUTRAL", 110.0), (None, day(1), "NEUTRAL", 1.0)]).withColumn("actual_price_t5", F.lit(7.0))
    new = record(spark, [("X-A", day(1), "BULLISH", 120.0), ("X-A", day(2), "NO_DECISION", 1.0)])
    rows = {r.signal_date: r for r in hist.upsert_signals(old, new, NOW).collect()}
    assert len(rows) == 2
    hit = rows[day(1)]
    assert (hit.signal, hit.signal_price, hit.revision, hit.actual_price_t5) == ("BULLISH", 120.0, 2, 7.0)
    again = {r.signal_date: r for r in hist.upsert_signals(hist.upsert_signals(old, new, NOW), new, NOW).collect()}
    assert again[day(1)].revision == 3 and len(again) == 2
    assert rows[day(0)].signal == "BEARISH" and rows[day(0)].revision == 1


def test_same_day_rerun_compares_with_its_own_row(spark):
    old = record(spark, [("X-A", day(0), "BEARISH", 1.0), ("X-A", day(1), "BULLISH", 1.0), ("X-A", day(2), "NO_DECISION", 1.0)])
    row = hist.signal_transitions(old, record(spark, [("X-A", day(1), "BULLISH", 1.0)])).first()
    assert row.previous_signal == "BULLISH" and row.signal_changed is False
    first = hist.signal_transitions(old.where("1 = 0"), record(spark, [("X-A", day(1), "BULLISH", 1.0)])).first()
    assert first.previous_signal is None and first.signal_changed is False


def test_a_close_equal_to_its_mean_is_not_above_it(spark):
    ends = [day(i) for i in range(29, 60, 10)]
    rows = features.symbol_features(tied_bars(spark)).where(F.col("date").isin(ends))
    assert [r.above_ma20 for r in rows.collect()] == [False] * 4
