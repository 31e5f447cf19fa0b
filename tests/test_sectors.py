import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlake.operators import features, normalize, rotation, sectors, transition as tr

D0 = dt.date(2026, 1, 1)


def eod(spark, code, n, first=100.0, step=1.0, exchange="hose"):
    rows = [(exchange, code, D0 + dt.timedelta(days=i), first + step * i, 1000.0 + 10 * i) for i in range(n)]
    return spark.createDataFrame(rows, "exchange string, code string, date date, ad_close double, nm_volume double")


def sector_rows(spark, series):
    rows = []
    for code, rets in series.items():
        for i, r in enumerate(rets):
            rows.append((D0 + dt.timedelta(days=i), code, 2, 100.0 + i, r, r, 50.0))
    return spark.createDataFrame(
        rows, "date date, sector_code string, sector_level int, sector_index double, sector_return double, relative_strength double, ma20 double"
    )


def test_features_golden(spark):
    rows = features.symbol_features(eod(spark, "abc", 30)).orderBy("date").collect()
    assert rows[0].symbol_key == "HOSE-ABC"
    assert rows[1].return_1d == pytest.approx(0.01)
    assert rows[5].return_5d == pytest.approx(0.05)
    assert rows[18].ma20 is None and rows[18].above_ma20 is False
    assert rows[19].ma20 == pytest.approx(109.5)
    assert rows[0].forward_return_t5 == pytest.approx(0.05)
    assert rows[-1].forward_return_t5 is None
    strict = features.symbol_features(eod(spark, "abc", 30), strict_ready=True).orderBy("date").collect()
    assert strict[0].above_ma20 is None


def test_last_duplicate_wins_after_null_closes_are_dropped(spark):
    rows = [("X", "A", D0, "10", 0), ("X", "A", D0, "n/a", 1), ("X", "A", D0 + dt.timedelta(days=1), "11", 0), ("X", "A", D0 + dt.timedelta(days=1), "12", 1)]
    df = spark.createDataFrame(rows, "exchange string, code string, date date, ad_close string, _seq int")
    got = {r.date.day: r.close for r in normalize.normalize_eod(df).collect()}
    assert got == {1: 10.0, 2: 12.0}


def _two_members(spark, n=25):
    both = eod(spark, "MBB", n, 100.0).unionByName(eod(spark, "ACB", n, 200.0))
    listed = spark.createDataFrame([("HOSE", "MBB", "BANKS"), ("HOSE", "ACB", "BANKS")], "exchange string, code string, lv string")
    return features.symbol_features(both), listed


def test_sector_aggregate_golden(spark):
    feats, listed = _two_members(spark)
    rows = sectors.sector_features(feats, listed, {2: "lv"}).orderBy("date").collect()
    assert rows[0].sector_index == pytest.approx(100.0)
    assert rows[1].sector_return == pytest.approx((1 / 100 + 1 / 200) / 2)
    assert [c.symbol for c in rows[1].contributors] == ["MBB", "ACB"]
    assert rows[1].contributors[0].weight == 0.5
    assert rows[1].coverage_ratio == 1.0
    assert rows[0].top_3_contribution_share == 0.0
    assert rows[1].top_3_contribution_share == pytest.approx(1.0)


def test_top3_takes_signed_order_then_absolute_sums(spark):
    day = [("HOSE", s, D0, r, False) for s, r in (("A", 0.04), ("B", 0.02), ("C", 0.01), ("D", -0.10))]
    feats = spark.createDataFrame(day, "exchange string, symbol string, date date, return_1d double, above_ma20 boolean")
    listed = spark.createDataFrame([("HOSE", s, "X") for s in "ABCD"], "exchange string, code string, lv string")
    row = sectors.sector_contributors(feats, listed, {1: "lv"}).first()
    assert row.top_3_contribution_share == pytest.approx(0.07 / 0.17)


def test_coverage_counts_codes_over_all_exchanges(spark):
    both = eod(spark, "AAA", 3).unionByName(eod(spark, "AAA", 3, exchange="hnx"))
    listed = spark.createDataFrame([("HOSE", "AAA", "X"), ("HNX", "AAA", "X")], "exchange string, code string, lv string")
    rows = sectors.sector_daily(features.symbol_features(both), listed, {1: "lv"}).collect()
    assert {r.coverage_ratio for r in rows} == {2.0}


def test_market_strength(spark):
    daily = sector_rows(spark, {"A": [0.01, 0.02, 0.03]}).drop("relative_strength")
    market = spark.createDataFrame([(D0 + dt.timedelta(days=i), 100.0 + i) for i in range(2)], "date date, ad_close double")
    rows = sectors.with_relative_strength(daily, sectors.market_returns(market)).orderBy("date").collect()
    assert rows[1].relative_strength == pytest.approx(0.02 - 0.01)
    assert rows[2].relative_strength is None


def test_rotation_golden(spark):
    rows = rotation.rotation_backtest(sector_rows(spark, {"BANKS": [0.01] * 8, "RETAIL": [0.005] * 8})).orderBy("date").collect()
    assert {r.sector_code for r in rows} == {"BANKS"}
    assert rows[0].sector_wave == "LEADING" and rows[0].transition is None and rows[0].lag_sessions == 0
    assert rows[1].transition == "BANKS->BANKS" and rows[1].lag_sessions == 1
    assert rows[0].forward_return_t5 == pytest.approx(1.01**5 - 1)
    assert rows[3].forward_return_t5 is None


def test_rotation_ties_nulls_and_missing_sessions(spark):
    df = sector_rows(spark, {"B": [0.01, None, 0.01, 0.01, 0.01, 0.01, 0.01], "A": [0.01, None, 0.0, 0.0, 0.0, 0.0, 0.0]})
    rows = {r.date.day: r for r in rotation.rotation_backtest(df).collect()}
    assert rows[1].sector_code == "A"  # tie: smaller code
    assert 2 not in rows  # no strength, no winner
    assert rows[1].forward_return_t5 is None  # a null inside the window
    gap = df.where(~((F.col("sector_code") == "A") & (F.dayofmonth("date") == 4)))
    assert {r.date.day: r for r in rotation.rotation_backtest(gap).collect()}[1].forward_return_t5 is None


REQUEST = dict(sector_codes=["retail", " BANKS ", "BANKS"], focus_sector_codes=["banks"], sector_level=2, horizons=[1])


def _request(day, **kw):
    return tr.TransitionRequest(evaluation_date=dt.date(2026, 1, day), **{**REQUEST, **kw})


def _history(spark, n=9):
    return sector_rows(spark, {"BANKS": [0.01 * (i + 1) for i in range(n)], "RETAIL": [0.05 - 0.01 * i for i in range(n)]})


def test_transition_at_t(spark):
    out = tr.analyze(_history(spark, 7), _request(7))
    predictions = out.predictions.collect()
    assert {p.from_sector for p in predictions} == {"BANKS"} and len(predictions) == 2
    assert predictions[0].current_relative_strength == pytest.approx(0.07)
    assert predictions[0].target_date is None
    assert out.probabilities.count() == 4
    assert {d.visibility for d in out.decisions.collect()} == {"PRIVATE_INTERNAL"}


def test_no_look_ahead(spark):
    request = _request(5, horizons=[1, 2])
    full, cut = _history(spark), _history(spark).where("date <= date'2026-01-05'")
    for name in ("probabilities", "predictions"):
        a = sorted(map(str, getattr(tr.analyze(full, request), name).collect()))
        b = sorted(map(str, getattr(tr.analyze(cut, request), name).collect()))
        assert a == b


def test_probability_rows_sum_to_one(spark):
    rows = tr.probabilities(_history(spark), _request(9)).collect()
    sums = {}
    for r in rows:
        sums[r.from_sector] = sums.get(r.from_sector, 0) + r.probability
    assert all(s == pytest.approx(1.0) for s in sums.values())


def test_blocked_universe(spark):
    request = _request(5, sector_codes=["BANKS", "MEDIA"], focus_sector_codes=[])
    assert [r.sector_code for r in tr.missing_sector_states(_history(spark), request).collect()] == ["MEDIA"]
    with pytest.raises(ValueError, match="BLOCKED"):
        tr.require_sector_states(_history(spark), request)
    with pytest.raises(ValueError):
        _request(5, focus_sector_codes=["MEDIA"]).focus


def test_leader_with_null_strength_ranks_last(spark):
    df = sector_rows(spark, {"A": [None, None], "B": [0.01, None]})
    got = {r.date.day: r.leader for r in tr.daily_leaders(df).collect()}
    assert got == {1: "B", 2: "A"}


def test_forward_return_needs_more_than_h_rows(spark):
    df = sector_rows(spark, {"A": [0.1, 0.1, 0.1]})
    got = {r.horizon_sessions: r.predicted_return for r in tr.historical_forward_return(df, [2, 3]).collect()}
    assert got[2] == pytest.approx(0.21) and got[3] == 0.0


def test_transition_outcomes(spark):
    history = _history(spark)
    request = _request(5, horizons=[1, 3, 9])
    predicted = tr.analyze(history, request).predictions
    rows = {(r.to_sector, r.horizon_sessions): r for r in tr.outcomes(predicted, history, request).collect()}
    assert ("BANKS", 9) not in rows
    assert rows[("BANKS", 1)].realized_return == pytest.approx(0.06)
    assert rows[("BANKS", 3)].realized_return == pytest.approx(1.06 * 1.07 * 1.08 - 1)
    assert str(rows[("BANKS", 3)].resolved_date) == "2026-01-08"
    legacy = predicted.drop("from_sector", "to_sector", "target_date").withColumnRenamed("horizon_sessions", "horizon")
    old = tr.outcomes(legacy, history, request).collect()
    assert old and all(r.target_date == r.resolved_date and r.from_sector == r.to_sector for r in old)


def test_sector_records_of_every_level(spark):
    import __spark_entry__ as entry

    for name in ("sector_records_merge_levels", "sectors_upsert_levels"):
        levels = {r[0] for r in entry.queries()[name](spark, "/root/testdata/sf0.001").select("taxonomy_level").distinct().collect()}
        assert levels == {1, 2, 3}  # these companies have no fourth level


def test_flat_contributors_equal_the_nested_ones(spark):
    """Ties go by symbol, members without a return contribute nothing, and parts of a sector day do not change its top."""
    day = dt.date(2024, 1, 2)
    rows = [(f"S{i:02d}", "HOSE", day, r, i % 2 == 0) for i, r in enumerate([0.1, None, -0.3, 0.1, 0.2, 0.1, 0.0, None])] + [("S00", "HOSE", dt.date(2024, 1, 3), None, None)]
    feats = spark.createDataFrame(rows, "symbol string, exchange string, date date, return_1d double, above_ma20 boolean")
    names = spark.createDataFrame([(f"S{i:02d}", "HOSE", "A") for i in range(8)], "code string, exchange string, sectorlv1code string")
    flat = sectors.contributor_rows(feats, names, {1: "sectorlv1code"})
    got = sorted((r.symbol, round(r.weight, 9), r["return"], round(r.contribution, 9), round(r.contribution_share, 9), r.above_ma20) for r in flat.where(F.col("date") == F.lit(day)).collect())
    nested = sectors.sector_contributors(feats, names, {1: "sectorlv1code"}).where(F.col("date") == F.lit(day)).first().contributors
    assert got == sorted((c.symbol, round(c.weight, 9), c["return"], round(c.contribution, 9), round(c.contribution_share, 9), c.above_ma20) for c in nested)
    for salts in (1, 3):
        top = sectors.top_contributors(flat, 3, salts).orderBy("date", "rank").collect()
        assert [(r.symbol, r["rank"]) for r in top] == [("S04", 1), ("S00", 2), ("S03", 3), ("S00", 1)]
    assert flat.where(F.col("date") == F.lit(dt.date(2024, 1, 3))).first().contribution_share == 0
