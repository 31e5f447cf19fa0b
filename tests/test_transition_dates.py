import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketlake.operators import transition as tr, transition_dates as td
from tests.compare import diff_rows

REQUEST = tr.TransitionRequest(dt.date(2024, 1, 1), ["a", "B", "c"], focus_sector_codes=["A", "b"], horizons=(1, 2, 4))
SCHEMA = "date date, sector_code string, sector_return double, relative_strength double"


@pytest.fixture(scope="module")
def sectors(spark):
    dice = random.Random(5)
    rows = []
    for day in range(60):
        for code in "ABCZ":
            if (code == "C" and day < 12) or dice.random() < 0.15:
                continue
            value = None if dice.random() < 0.1 else dice.uniform(-0.05, 0.05)
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=day), code, value, dice.choice([None, 0.1, 0.2, dice.random()])))
    return spark.createDataFrame(rows, SCHEMA).cache()


def _dates(spark, days):
    return spark.createDataFrame([(d,) for d in days], "evaluation_date date")


def test_dates_agree_with_single_runs(spark, sectors):
    days = [dt.date(2024, 1, 16), dt.date(2024, 2, 1), dt.date(2024, 2, 27), dt.date(2025, 1, 1)]
    history = td.analyze_dates(sectors, _dates(spark, [*days, days[0], None, dt.date(2024, 1, 5), dt.date(2023, 1, 1)]), REQUEST)
    got = {n: getattr(history, n).withColumn("_again", F.lit(0)).drop("_again").toPandas() for n in ("probabilities", "predictions", "decisions", "outcomes")}
    for day in days:
        one = replace(REQUEST, evaluation_date=day)
        single = tr.analyze(sectors, one)
        want = {"probabilities": single.probabilities, "predictions": single.predictions, "decisions": single.decisions,
                "outcomes": tr.outcomes(single.predictions.drop("target_date"), sectors, one)}
        for name, frame in want.items():
            mine = got[name][got[name]["evaluation_date"] == day].reset_index(drop=True)
            assert diff_rows(mine, frame.toPandas()) is None, (name, day)
    assert set(got["decisions"]["evaluation_date"]) == set(days)
    assert got["outcomes"]["evaluation_date"].max() < dt.date(2025, 1, 1)


def test_blocked_dates_and_states(spark, sectors):
    dates = _dates(spark, [dt.date(2024, 1, 5), dt.date(2023, 1, 1), dt.date(2024, 2, 1)])
    blocked = {(r.evaluation_date.isoformat(), r.sector_code) for r in td.blocked_dates(sectors, dates, REQUEST).collect()}
    assert blocked == {("2024-01-05", "C"), ("2023-01-01", "A"), ("2023-01-01", "B"), ("2023-01-01", "C")}
    states = td.states_at(sectors, dates, REQUEST).where("evaluation_date = date'2024-02-01'").drop("evaluation_date")
    want = tr.state_at(sectors, replace(REQUEST, evaluation_date=dt.date(2024, 2, 1)))
    assert diff_rows(states.toPandas(), want.select(*states.columns).toPandas()) is None
    ends = sorted(r.evaluation_date for r in td.month_ends(sectors).collect())
    assert ends == [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]


def test_empty_tables(spark, sectors):
    some, none = _dates(spark, [dt.date(2024, 2, 1)]), _dates(spark, [])
    nothing = td.analyze_dates(sectors.limit(0), some, REQUEST)
    assert nothing.predictions.count() == 0 and nothing.outcomes.count() == 0 and nothing.blocked.count() == 3
    asked = td.analyze_dates(sectors, none, REQUEST)
    assert asked.probabilities.count() == 0 and asked.decisions.count() == 0 and asked.blocked.count() == 0
