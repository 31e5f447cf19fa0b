"""Price alerts and screener presets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import keep_last
from marketlake.functions.numeric import safe_div

__all__ = ["screen", "triggered_alerts"]

_COMPARE = {
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "ne": lambda c, v: c != v,
}


def triggered_alerts(alerts: DataFrame, bars: DataFrame) -> DataFrame:
    """Alerts that fire on the latest bar of their symbol.

    ``above`` / ``below`` compare the close with the target; ``cross_up`` / ``cross_down``
    also need the previous close on the other side (or on the target); ``pct_change_up`` /
    ``pct_change_down`` compare the change to the previous close with ``target_pct`` percent.
    Bars are reduced to one row per symbol first, so an alert meets exactly one bar.
    """
    w = W.partitionBy("symbol").orderBy("date")
    last = keep_last(bars.withColumn("previous_close", F.lag("close").over(w)), ["symbol"], ["date"])
    close, before, target = F.col("close"), F.col("previous_close"), F.col("target_price")
    change = (safe_div(close, before) - 1.0) * 100.0
    fires = {
        "above": close > target,
        "below": close < target,
        "cross_up": (close > target) & (before <= target),
        "cross_down": (close < target) & (before >= target),
        "pct_change_up": change >= F.col("target_pct"),
        "pct_change_down": change <= -F.col("target_pct"),
    }
    hit = F.lit(False)
    for name, rule in fires.items():
        hit = hit | ((F.col("condition") == name) & F.coalesce(rule, F.lit(False)))
    return (
        alerts.where("is_active").join(last.select("symbol", "date", "close", "previous_close"), "symbol").where(hit)
        .select("alert_id", "symbol", "condition", F.col("date").alias("triggered_on"), close.alias("triggered_price"))
    )


def _condition(columns: list[str], name: str, value: object) -> Column:
    if name in columns:
        return F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value)
    field, _, op = name.rpartition("_")
    if field in columns and op in _COMPARE:
        return _COMPARE[op](F.col(field), F.lit(value))
    raise ValueError(f"unknown screener filter {name!r}")


def screen(df: DataFrame, filters: Mapping[str, object], sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """Rows that meet every filter: ``<column>`` for equality, ``<column>_lt/lte/gt/gte/ne`` else.

    The filters become plain column predicates, so Spark pushes them into the scan.
    """
    out = df
    for name, value in filters.items():
        out = out.where(_condition(df.columns, name, value))
    if sort_by is None:
        return out
    return out.orderBy(F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last())
