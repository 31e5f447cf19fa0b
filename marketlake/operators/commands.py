"""Job commands: JSON decoding, contract rules, code-list normalisation, status records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlake.functions.text import valid_symbol_key
from marketlake.schemas import COMMAND

__all__ = ["code_lists", "decode_json", "error_status", "status_records", "validated", "violations"]

# The names the contracts accept.
TIMEFRAMES = ["1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w", "1M"]
ENABLED_TIMEFRAMES = ["1d"]
INDICATORS = ["MA20", "MA50", "RSI14", "MACD", "ICHIMOKU"]
SIGNAL_STRATEGIES = ["TREND_MOMENTUM_V1"]
WAVE_STRATEGIES = ["SECTOR_WAVE_V1"]
TRANSITION_STRATEGIES = ["SECTOR_TRANSITION_V1"]
KINDS = [
    "indicators", "signals", "signal_evaluation", "symbol_features", "sector_features", "rotation_backtest",
    "sector_transition", "transition_outcomes",
]


def decode_json(df: DataFrame, value: str = "value", schema: StructType = COMMAND) -> DataFrame:
    """Parse a text or binary payload into columns plus ``malformed``.

    Anything but a JSON object is malformed; such rows are kept, with null fields, for the
    caller to route aside.
    """
    text = F.trim(F.col(value).cast("string"))
    with_bad = StructType([*schema.fields, StructField("_bad", StringType())])
    parsed = F.from_json(text, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = F.coalesce(~text.startswith("{"), F.lit(True)) | F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    return df.withColumn("_p", parsed).withColumn("malformed", broken).select(
        *df.columns, "malformed", *[F.when(~F.col("malformed"), F.col(f"_p.{n}")).alias(n) for n in schema.names]
    )


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _not_in(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(~c.isin(allowed), F.lit(True))


def _codes(c: Column) -> Column:
    filled = F.filter(c, lambda v: F.trim(v) != "")
    return F.array_sort(F.array_distinct(F.transform(filled, lambda v: F.upper(F.trim(v)))))


def code_lists(df: DataFrame, codes: str = "sectorCodes", focus: str = "focusSectorCodes") -> DataFrame:
    """Trimmed, upper-case, distinct, sorted code lists; an empty focus means the whole list.

    ``focus_outside`` holds focus codes that are not part of the list (an error when not empty).
    """
    out = df.withColumns({codes: _codes(F.col(codes)), focus: _codes(F.coalesce(F.col(focus), F.array().cast("array<string>")))})
    out = out.withColumn(focus, F.when(F.size(focus) == 0, F.col(codes)).otherwise(F.col(focus)))
    return out.withColumn("focus_outside", F.array_except(focus, codes))


def violations(kind: str = "kind") -> Column:
    """Rule codes a command breaks, by its kind. One table of (applies to, broken, code)."""
    k = F.col(kind)
    strategy = F.upper(F.trim("strategy"))
    none = F.array().cast("array<string>")
    upper_ind = F.transform(F.coalesce("indicators", none), F.upper)
    wave = ["sector_features", "rotation_backtest"]
    moves = ["sector_transition", "transition_outcomes"]
    listed = F.size(_codes(F.coalesce("sectorCodes", none)))
    outside = F.array_except(_codes(F.coalesce("focusSectorCodes", none)), _codes(F.coalesce("sectorCodes", none)))
    horizons = F.coalesce("predictionHorizons", F.array().cast("array<int>"))
    level_bad = F.coalesce(F.col("sectorLevel") < 1, F.lit(True))
    rules = [
        (KINDS, _not_in(F.col("timeframe"), TIMEFRAMES), "TIMEFRAME_UNKNOWN"),
        (KINDS, F.col("timeframe").isin(TIMEFRAMES) & ~F.col("timeframe").isin(ENABLED_TIMEFRAMES), "TIMEFRAME_NOT_ENABLED"),
        (["indicators", "signals", "symbol_features"], ~valid_symbol_key(F.col("symbolKey")), "SYMBOL_KEY_INVALID"),
        (["signal_evaluation"], _blank(F.col("exchange")), "EXCHANGE_REQUIRED"),
        (["indicators"], F.col("indicatorSource").isNull(), "INDICATOR_SOURCE_REQUIRED"),
        (["indicators"], (F.size(upper_ind) == 0) | (F.size(F.array_except(upper_ind, F.array(*[F.lit(i) for i in INDICATORS]))) > 0), "INDICATORS_UNSUPPORTED"),
        (["signals", "signal_evaluation"], _not_in(F.upper("strategy"), SIGNAL_STRATEGIES), "STRATEGY_UNSUPPORTED"),
        (["rotation_backtest"], _not_in(strategy, WAVE_STRATEGIES), "STRATEGY_UNSUPPORTED"),
        (moves, F.coalesce(~strategy.isin(TRANSITION_STRATEGIES), F.lit(False)), "STRATEGY_UNSUPPORTED"),
        (["sector_features"], _blank(F.col("sectorCode")), "SECTOR_CODE_REQUIRED"),
        (wave + moves, level_bad, "SECTOR_LEVEL_INVALID"),
        (["rotation_backtest", *moves], listed == 0, "SECTOR_CODES_REQUIRED"),
        (moves, F.size(outside) > 0, "FOCUS_OUTSIDE_SECTOR_CODES"),
        (moves, (F.size(horizons) == 0) | F.exists(horizons, lambda h: h <= 0), "HORIZONS_INVALID"),
        (moves, F.col("evaluationDate").try_cast("date").isNull(), "EVALUATION_DATE_INVALID"),
    ]
    found = [F.when(k.isin(kinds) & broken, F.lit(code)) for kinds, broken, code in rules]
    found.append(F.when(~F.coalesce(k.isin(KINDS), F.lit(False)), F.lit("KIND_UNKNOWN")))
    return F.array_compact(F.array(*found))


def validated(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Add ``violations``; a command without any is valid."""
    return df.withColumn("violations", violations(kind))


def _duration_ms(start: str, end: str) -> Column:
    return F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))


def status_records(df: DataFrame, key_field: str = "symbolKey") -> DataFrame:
    """Status rows for finished work: resolved key, counts, offset and duration.

    The key falls back to ``unknown``; a status outside the three known ones raises.
    """
    status = F.upper(F.trim("status"))
    checked = F.when(status.isin("SUCCESS", "ERROR", "PARTIAL_SUCCESS"), status).otherwise(
        F.raise_error(F.concat(F.lit("unknown job status: "), F.coalesce("status", F.lit("null")))).cast("string")
    )
    return df.select(
        F.coalesce(F.col(key_field), F.lit("unknown")).alias(key_field),
        *[c for c in ("jobDefinitionId", "executionId", "parentExecutionId") if c in df.columns],
        checked.alias("status"),
        F.col("records_inserted").alias("recordsProcessed"),
        F.create_map(
            F.lit("recordsInserted"), F.col("records_inserted").cast("string"),
            F.lit("totalRecords"), F.col("total_records").cast("string"),
        ).alias("metaJson"),
        F.col("new_offset").alias("newOffset"),
        "startedAt", "finishedAt", _duration_ms("startedAt", "finishedAt").alias("durationMs"),
        F.col("error_message").alias("errorMessage"),
    )


def error_status(rejected: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """ERROR status of an invalid command, keeping its ids and its remaining fields as metadata."""
    ids = {"jobDefinitionId", "executionId", "parentExecutionId", "symbolKey"}
    rest = [n for n in COMMAND.names if n not in ids and n != "metadata" and n in rejected.columns]
    pairs = [x for n in rest for x in (F.lit(n), _as_text(rejected, n))]
    message = F.concat_ws(", ", "violations")
    meta = F.map_filter(
        F.create_map(*pairs, F.lit("recordsProcessed"), F.lit("0"), F.lit("errorMessage"), message),
        lambda _, v: v.isNotNull(),
    )
    return rejected.select(
        *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("jobDefinitionId", "executionId", "symbolKey")],
        "parentExecutionId", F.lit("ERROR").alias("status"), started_at.alias("startedAt"),
        finished_at.alias("finishedAt"), message.alias("errorMessage"), F.lit(0).alias("recordsProcessed"),
        (F.unix_millis(finished_at) - F.unix_millis(started_at)).alias("durationMs"), meta.alias("metaJson"),
        F.lit(None).cast("string").alias("newOffset"),
    )


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.array_join(F.col(name).cast("array<string>"), ",") if kind == "array" else F.col(name).cast("string")
