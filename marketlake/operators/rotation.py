"""Sector wave classes and the rotation backtest over daily winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import first_n
from marketlake.functions.numeric import compounded
from marketlake.operators.features import FORWARD_WINDOWS

__all__ = ["rotation_backtest", "rotation_winners", "sector_wave_class", "with_forward_sector_returns"]


def sector_wave_class() -> Column:
    """Quadrant of a sector day; a null strength or return counts as 0."""
    strength = F.coalesce("relative_strength", F.lit(0.0))
    ret = F.coalesce("sector_return", F.lit(0.0))
    above = F.coalesce(F.col("sector_index") > F.col("ma20"), F.lit(False))
    return (
        F.when((strength > 0) & (ret > 0) & above, "LEADING")
        .when(strength > 0, "IMPROVING")
        .when(ret < 0, "WEAKENING")
        .otherwise("LAGGING")
    )


def rotation_winners(sectors: DataFrame) -> DataFrame:
    """The strongest sector of each day with its predecessor in the winner stream.

    A day whose strengths are all null has no winner. Ranking runs per (level, date); the
    windows over time start only after the reduction to one row per level and date.
    """
    ranked = first_n(
        sectors.where("relative_strength is not null"), ["sector_level", "date"],
        [F.col("relative_strength").desc(), F.col("sector_code").asc()],
    ).withColumn("rank", F.lit(1))
    stream = W.partitionBy("sector_level").orderBy("date")
    same = W.partitionBy("sector_level", "sector_code").orderBy("date")
    out = ranked.withColumns(
        {"previous_sector_code": F.lag("sector_code").over(stream), "_pos": F.row_number().over(stream)}
    )
    lag_sessions = F.coalesce(F.col("_pos") - F.lag("_pos").over(same), F.lit(0))
    transition = F.concat("previous_sector_code", F.lit("->"), "sector_code")
    return out.withColumns({"lag_sessions": lag_sessions, "transition": transition}).drop("_pos")


def with_forward_sector_returns(sectors: DataFrame) -> DataFrame:
    """Compounded return of the next w sessions of the level's calendar.

    The calendar is the union of dates over all sectors of a level; a sector that misses
    one of the w sessions, or has a null return on it, gets null. Sessions are numbered by
    a dense rank over the level's dates and the frame is a range over that number: one pass
    over the sector rows, no calendar join and no pair of rows. A level holds one row per
    sector and trading day.
    """
    sessions = W.partitionBy("sector_level").orderBy("date")
    w = W.partitionBy("sector_level", "sector_code").orderBy("_session")
    return (
        sectors.withColumn("_session", F.dense_rank().over(sessions))
        .withColumns(
            {f"forward_return_t{n}": compounded("sector_return", w.rangeBetween(1, n), n) for n in FORWARD_WINDOWS}
        )
        .drop("_session")
    )


def rotation_backtest(sectors: DataFrame, strategy: str = "SECTOR_WAVE_V1") -> DataFrame:
    """Rule-based rotation: hold each day's winner, report transitions and realised returns."""
    winners = rotation_winners(with_forward_sector_returns(sectors))
    return winners.select(
        "date", F.lit(strategy.upper()).alias("strategy"), "sector_level", "sector_code", "rank",
        "sector_return", "relative_strength", sector_wave_class().alias("sector_wave"),
        "previous_sector_code", "transition", "lag_sessions",
        *[f"forward_return_t{n}" for n in FORWARD_WINDOWS],
    )
