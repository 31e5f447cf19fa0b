"""Transition analyses at many evaluation dates in one pass: T is a column.

The results at a date are those of :mod:`marketlake.operators.transition` for a request at that date. Nothing is cut and
repeated per date: what was known at T is a running value of the sector's series, carried to T by one ordered window, and a
pair of leaders counts from the first evaluation date at which its later session is known.

``sectors`` are the sector rows of the request's level, one per sector and day, ``dates`` a frame with ``evaluation_date``;
null dates and repeats are left out. Windows run over a sector's calendar, those over time alone on one row per day. Dates
at which a sector of the universe has no state yet are blocked: they give no rows but those of :func:`blocked_dates`.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import require_columns
from marketlake.functions.numeric import compounded, safe_div
from marketlake.operators import transition as tr

__all__ = [
    "TransitionHistory", "analyze_dates", "blocked_dates", "month_ends", "outcomes_at", "predictions_at", "probabilities_at",
    "states_at",
]


def month_ends(sectors: DataFrame) -> DataFrame:
    """The last session of each month, as evaluation dates."""
    return sectors.groupBy(F.trunc("date", "month").alias("_month")).agg(F.max("date").alias("evaluation_date")).select("evaluation_date")


def _asked(dates: DataFrame) -> DataFrame:
    return dates.select(F.col("evaluation_date").cast("date").alias("evaluation_date")).where("evaluation_date is not null").distinct()


def _each(values: Sequence) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _rows(sectors: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    require_columns(sectors, ["date", "sector_code", "sector_return", "relative_strength"], "sector rows")
    if "sector_level" in sectors.columns:
        sectors = sectors.where(F.col("sector_level") == request.sector_level)
    return sectors.select("date", F.upper("sector_code").alias("sector_code"), "sector_return", "relative_strength").where(
        F.col("sector_code").isin(request.universe) & F.col("date").isNotNull()
    )


def _series(sectors: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """Each row's position in its sector, the return of the h rows that end there, and the running sums of these."""
    w = W.partitionBy("sector_code").orderBy("date")
    placed = _rows(sectors, request).withColumns(
        {"pos": F.row_number().over(w)} | {f"c{h}": compounded("sector_return", w.rowsBetween(-(h - 1), 0)) for h in request.horizons}
    )
    return placed.withColumns({f"s{h}": F.sum(F.when(F.col("pos") >= h, F.col(f"c{h}"))).over(w) for h in request.horizons})


def _anchored(series: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """(evaluation_date, sector_code, at): the last row of each sector at or before each date, null where there is none."""
    held = F.struct(F.col("date"), "sector_return", "relative_strength", "pos", *[f"s{h}" for h in request.horizons])
    rows = series.select("sector_code", "date", F.lit(False).alias("asked"), held.alias("at"))
    marks = _asked(dates).select(
        _each(request.universe).alias("sector_code"), F.col("evaluation_date").alias("date"), F.lit(True).alias("asked"),
        F.lit(None).cast(rows.schema["at"].dataType).alias("at"),
    )
    w = W.partitionBy("sector_code").orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0)
    carried = rows.unionByName(marks).withColumn("at", F.last("at", ignorenulls=True).over(w))
    return carried.where("asked").select(F.col("date").alias("evaluation_date"), "sector_code", "at")


def _open(anchored: DataFrame) -> DataFrame:
    """The rows of the dates at which every sector has a state."""
    ready = F.count("at").over(W.partitionBy("evaluation_date")) == F.count("*").over(W.partitionBy("evaluation_date"))
    return anchored.withColumn("_ready", ready).where("_ready").drop("_ready")


def states_at(sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """The last row at or before each date per sector, blocked dates included; sectors without one have no row."""
    return _anchored(_series(sectors, request), dates, request).where("at is not null").select(
        "evaluation_date", "sector_code", F.col("at.date").alias("date"), "at.sector_return", "at.relative_strength"
    )


def blocked_dates(sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """(evaluation_date, sector_code, status) for each sector of the universe without a state at a date."""
    return _anchored(_series(sectors, request), dates, request).where("at is null").select(
        "evaluation_date", "sector_code", F.lit("BLOCKED").alias("status")
    )


def _labels(request: tr.TransitionRequest) -> list[Column]:
    return [
        F.lit(None).cast("date").alias("target_date"), F.lit(request.strategy).alias("strategy"),
        F.lit(request.timeframe).alias("timeframe"), F.lit(request.sector_level).alias("sector_level"),
    ]


def _new_pairs(sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """Pairs of leaders by the first evaluation date that knows them: (evaluation_date, h, from, to, found)."""
    leaders = tr.daily_leaders(_rows(sectors, request)).select("date", "leader", F.lit(None).cast("date").alias("asked"))
    marks = _asked(dates).select(F.col("evaluation_date").alias("date"), F.lit(None).cast("string").alias("leader"), F.col("evaluation_date").alias("asked"))
    day = W.partitionBy().orderBy("date")
    due = leaders.unionByName(marks).withColumn("due", F.min("asked").over(day.rangeBetween(W.currentRow, W.unboundedFollowing)))
    days = due.where("asked is null")
    ahead = F.array(*[
        F.struct(F.lit(h).alias("h"), F.lead("leader", h).over(day).alias("to"), F.lead("due", h).over(day).alias("due")) for h in request.horizons
    ])
    pairs = days.select(F.col("leader").alias("from_sector"), ahead.alias("_ahead")).withColumn("_a", F.explode("_ahead"))
    return pairs.where("_a.to is not null and _a.due is not null").groupBy(
        F.col("_a.due").alias("evaluation_date"), F.col("_a.h").alias("horizon_sessions"), "from_sector", F.col("_a.to").alias("to_sector")
    ).agg(F.count("*").alias("found"))


def probabilities_at(sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """The full matrix of every date, blocked ones included: pairs known by then, zeros for those never seen."""
    key = ["horizon_sessions", "from_sector", "to_sector"]
    grid = (
        _asked(dates).withColumn("from_sector", _each(request.universe)).withColumn("to_sector", _each(request.universe))
        .withColumn("horizon_sessions", _each(list(request.horizons)))
    )
    so_far = W.partitionBy(*key).orderBy("evaluation_date").rowsBetween(W.unboundedPreceding, 0)
    row = W.partitionBy("evaluation_date", "horizon_sessions", "from_sector")
    return (
        grid.join(_new_pairs(sectors, dates, request), ["evaluation_date", *key], "left")
        .withColumn("seen", F.sum(F.coalesce("found", F.lit(0))).over(so_far))
        .withColumn("sample_count", F.sum("seen").over(row))
        .select(
            "evaluation_date", *_labels(request), *key, F.coalesce(safe_div("seen", "sample_count"), F.lit(0.0)).alias("probability"),
            "sample_count", F.lit(tr.MODEL_VERSION).alias("model_version"),
        )
    )


def predictions_at(sectors: DataFrame, dates: DataFrame, matrix: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """Focus state at T, its transition probabilities and the target's mean return known at T, for every date not blocked."""
    anchored = _open(_anchored(_series(sectors, request), dates, request))
    state = anchored.where(F.col("sector_code").isin(request.focus)).select(
        "evaluation_date", F.col("sector_code").alias("from_sector"), F.col("at.relative_strength").alias("current_relative_strength"),
        F.col("at.sector_return").alias("current_sector_return"), F.col("at.date").alias("generated_from_date"),
    )
    pos = F.col("at.pos")
    means = F.array(*[
        F.struct(F.lit(h).alias("h"), F.when(pos > h, F.col(f"at.s{h}") / (pos - (h - 1))).otherwise(0.0).alias("mean")) for h in request.horizons
    ])
    expected = anchored.select("evaluation_date", F.col("sector_code").alias("to_sector"), F.explode(means).alias("_m")).select(
        "evaluation_date", "to_sector", F.col("_m.h").alias("horizon_sessions"), F.col("_m.mean").alias("predicted_return")
    )
    return (
        matrix.join(state, ["evaluation_date", "from_sector"]).join(expected, ["evaluation_date", "to_sector", "horizon_sessions"])
        .select(
            "evaluation_date", "target_date", "strategy", "timeframe", "sector_level", F.col("to_sector").alias("sector_code"),
            "from_sector", "to_sector", "horizon_sessions", "current_relative_strength", "current_sector_return", "predicted_return",
            F.col("probability").alias("transition_probability"), "sample_count", "generated_from_date", "model_version",
        )
    )


def outcomes_at(predicted: DataFrame, sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> DataFrame:
    """Realised return of each prediction over the first h rows of its sector after its date; none where fewer follow.

    These rows end h positions behind the one that T stands at, so the return is that row's own h-row return.
    """
    series = _series(sectors, request)
    stand = _anchored(series, dates, request).where("at is not null").select("evaluation_date", F.col("sector_code").alias("to_sector"), F.col("at.pos").alias("_pos"))
    ends = F.array(*[F.struct(F.lit(h).alias("h"), (F.col("pos") - h).alias("pos"), F.col(f"c{h}").alias("c")) for h in request.horizons])
    realised = series.select(F.col("sector_code").alias("to_sector"), F.col("date").alias("resolved_date"), F.explode(ends).alias("_e")).select(
        "to_sector", "resolved_date", F.col("_e.h").alias("horizon_sessions"), F.col("_e.pos").alias("_pos"), F.col("_e.c").alias("realized_return")
    )
    found = predicted.drop("target_date").join(stand, ["evaluation_date", "to_sector"]).join(realised, ["to_sector", "horizon_sessions", "_pos"])
    expected, actual = tr.direction(F.col("predicted_return")), tr.direction(F.col("realized_return"))
    return found.select(
        "evaluation_date", "resolved_date", F.col("resolved_date").alias("target_date"), "strategy", "timeframe", "sector_level",
        F.col("to_sector").alias("sector_code"), "from_sector", "to_sector", "horizon_sessions", "predicted_return", "realized_return",
        expected.alias("predicted_direction"), actual.alias("realized_direction"), (expected == actual).alias("direction_correct"), "model_version",
    )


@dataclass(frozen=True)
class TransitionHistory:
    probabilities: DataFrame
    predictions: DataFrame
    decisions: DataFrame
    outcomes: DataFrame
    blocked: DataFrame


def analyze_dates(sectors: DataFrame, dates: DataFrame, request: tr.TransitionRequest) -> TransitionHistory:
    """Every result at every date; the request's own evaluation date is not used. ``sectors`` is read several times."""
    matrix = probabilities_at(sectors, dates, request)
    predicted = predictions_at(sectors, dates, matrix, request)
    return TransitionHistory(
        matrix, predicted, tr.decisions(predicted), outcomes_at(predicted, sectors, dates, request), blocked_dates(sectors, dates, request)
    )
