"""Which duplicate wins, and column checks.

``keep_first`` / ``keep_last`` filter ``row_number() = 1`` right above the window, the
shape for which Spark adds a map-side ``WindowGroupLimit``: each task forwards at most one
row per key, so a key holding a large share of the rows does not reach one reducer whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

__all__ = ["first_n", "keep_first", "keep_last", "last_of_each_date", "require_columns", "with_seq"]


def require_columns(df: DataFrame, names: Sequence[str], what: str = "input") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_seq",)) -> DataFrame:
    """The row with the smallest ``order`` value per key."""
    return first_n(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_seq",)) -> DataFrame:
    """The row with the largest ``order`` value per key."""
    return first_n(df, keys, [F.col(c).desc_nulls_last() for c in order])


def last_of_each_date(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key and date, by a window over the series: windows over the same series that
    follow share its partitioning and its sort."""
    w = W.partitionBy(*keys).orderBy("date", *[F.col(c).asc_nulls_first() for c in order])
    day = F.struct("date")
    return df.withColumn("_again", F.lead(day).over(w).eqNullSafe(day)).where("not _again").drop("_again")


def with_seq(*frames: DataFrame) -> DataFrame:
    """Union by name, tagging each row with the position of the frame it came from."""
    tagged = [f.withColumn("_seq", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
