"""Column names, EOD preparation and small schema conversions."""

from __future__ import annotations

from collections import defaultdict
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlake.functions.keyed import keep_first, keep_last, last_of_each_date, require_columns
from marketlake.functions.numeric import nan_to_null, to_double
from marketlake.functions.text import blank_to_null, snake_case

__all__ = [
    "clean_value", "eod_merge_keep_first", "fetch_size", "merge_keep_last", "normalize_columns",
    "normalize_eod", "prepare_eod", "upgrade_predictions", "with_indicator_source_check",
]

EOD_REQUIRED = ("date", "ad_open", "ad_high", "ad_low", "ad_close", "nm_volume")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Snake-case every column name.

    Columns whose names fall together are coalesced; a row where two of them hold
    different non-null values raises when the row is evaluated.
    """
    sources: dict[str, list[str]] = defaultdict(list)
    for name in df.columns:
        sources[snake_case(name)].append(name)
    return df.select(*[_merged(target, names).alias(target) for target, names in sources.items()])


def _merged(target: str, names: list[str]) -> Column:
    cols = [F.col(f"`{n}`") for n in names]
    if len(cols) == 1:
        return cols[0]
    value = F.coalesce(*cols)
    clash = F.lit(False)
    for c in cols:
        clash = clash | (c.isNotNull() & (c != value))
    message = F.lit(f"columns {names} all map to {target!r} with different values")
    return F.when(~F.coalesce(clash, F.lit(False)), value).otherwise(
        F.raise_error(message).cast(T.StringType())
    )


def prepare_eod(
    df: DataFrame, source: str = "ad_close", keys: tuple[str, ...] = ("code",),
    order: tuple[str, ...] = ("_seq",),
) -> DataFrame:
    """Indicator input: required columns, last duplicate per date, numeric coercion.

    Rows without the order columns are ordered by their values, so that one row a date is left in any case.
    """
    require_columns(df, [*EOD_REQUIRED, source, *keys], "EOD data")
    out = df.withColumn("date", F.col("date").cast("date"))
    numeric = dict.fromkeys(["ad_open", "ad_high", "ad_low", "ad_close", source])
    known = set(order) <= set(out.columns)
    out = keep_last(out, [*keys, "date"], order) if known else last_of_each_date(out, keys, list(numeric))
    return out.withColumns({c: to_double(c) for c in numeric})


def with_indicator_source_check(df: DataFrame, source: str, keys: tuple[str, ...]) -> DataFrame:
    """Series without a single numeric source value, to be reported before computing."""
    return df.groupBy(*keys).agg(F.count(to_double(source)).alias("n_values")).where("n_values = 0")


def normalize_eod(
    df: DataFrame, keys: tuple[str, ...] = ("exchange", "code"), order: tuple[str, ...] = ("_seq",),
) -> DataFrame:
    """Feature input: ``date / close / volume``, null closes dropped before the last
    duplicate per date is chosen; a missing volume column counts as 0. Rows without an order
    column are ordered by their values."""
    require_columns(df, ["date", "ad_close", *keys], "EOD frame")
    volume = to_double("nm_volume") if "nm_volume" in df.columns else F.lit(0.0)
    ordered = [c for c in order if c in df.columns]
    out = df.select(
        *keys, F.col("date").cast("date").alias("date"), to_double("ad_close").alias("close"),
        volume.alias("volume"), *ordered,
    ).dropna(subset=["date", "close"])
    if not ordered:
        return last_of_each_date(out, keys, ["close", "volume"])
    return keep_last(out, [*keys, "date"], ordered).drop(*ordered)


def eod_merge_keep_first(existing: DataFrame, incoming: DataFrame, keys=("code", "date")) -> DataFrame:
    """Incremental EOD merge: a stored row wins over a corrected provider row of the same date."""
    both = existing.withColumn("_seq", F.lit(0)).unionByName(
        incoming.withColumn("_seq", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, list(keys)).drop("_seq")


def merge_keep_last(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: the incoming row wins; columns unknown to one side become null."""
    both = existing.withColumn("_seq", F.lit(0)).unionByName(
        incoming.withColumn("_seq", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, keys).drop("_seq")


def clean_value(df: DataFrame, name: str) -> Column:
    """Blank text and NaN to null, timestamps to ISO dates."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(c)
    return blank_to_null(c) if isinstance(kind, T.StringType) else c


def upgrade_predictions(df: DataFrame) -> DataFrame:
    """Older prediction rows: ``horizon`` for ``horizon_sessions``, one sector column for both ends."""
    if "horizon_sessions" not in df.columns and "horizon" in df.columns:
        df = df.withColumn("horizon_sessions", F.col("horizon"))
    for name in ("from_sector", "to_sector"):
        if name not in df.columns:
            df = df.withColumn(name, F.col("sector_code"))
    return df


def fetch_size(from_day: Column, to_day: date) -> Column:
    """Rows to ask a provider for: the day span, at least 1; 10 000 without a known offset."""
    span = F.greatest(F.datediff(F.lit(to_day), from_day) + 1, F.lit(1))
    return F.when(from_day.isNull(), 10000).otherwise(span).cast("bigint")
