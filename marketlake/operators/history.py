"""Signal history: conform, integrity checks, change detection, upsert, outcome back-fill."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlake.functions.keyed import keep_last, require_columns
from marketlake.functions.numeric import nan_to_null, safe_div
from marketlake.schemas import SIGNAL_HISTORY

__all__ = [
    "OUTCOME_WINDOWS", "SIGNAL_KEY", "canonical_order", "conform_history", "current_signals",
    "fill_outcomes", "history_violations", "missing_eod_symbols", "outcome_summary",
    "resolved_outcomes", "signal_transitions", "upsert_signals",
]

# Key columns, outcome horizons in sessions and the accepted signals.
SIGNAL_KEY = ["symbol_key", "strategy", "timeframe", "signal_date"]
OUTCOME_WINDOWS = (5, 10, 15, 20)
VALID_SIGNALS = ("BULLISH", "NEUTRAL", "BEARISH", "NO_DECISION")
OUTCOME_COLUMNS = [f"actual_{kind}_t{n}" for n in OUTCOME_WINDOWS for kind in ("price", "return")] + [
    "actual_updated_at"
]


def conform_history(df: DataFrame) -> DataFrame:
    """Bring older rows to the full schema: missing columns null, ``price`` as
    ``signal_price``, upper-case signal, revision at least 1."""
    if "price" in df.columns and "signal_price" not in df.columns:
        df = df.withColumnRenamed("price", "signal_price")
    out = df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
            if f.name != "reason_codes"
            else (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in SIGNAL_HISTORY.fields
        ]
    )
    revision = F.greatest(F.coalesce("revision", F.lit(1)), F.lit(1))
    return out.withColumns({"signal": F.upper("signal"), "revision": revision.cast("int")})


#: Order of a stored history.
CANONICAL_ORDER = ["strategy", "timeframe", "exchange", "symbol_key", "signal_date"]


def canonical_order(df: DataFrame) -> DataFrame:
    """Order inside the written files; no global sort is needed. Writers by partition take :data:`CANONICAL_ORDER` as their order."""
    return df.sortWithinPartitions(*CANONICAL_ORDER)


def history_violations(df: DataFrame) -> DataFrame:
    """One row of counts: null keys, duplicate keys, rows with an unknown signal."""
    require_columns(df, [f.name for f in SIGNAL_HISTORY.fields], "signal history")
    null_key = F.lit(False)
    for c in SIGNAL_KEY:
        null_key = null_key | F.col(c).isNull()
    invalid = ~F.coalesce(F.upper("signal").isin(*VALID_SIGNALS), F.lit(False))
    per_key = df.groupBy(*SIGNAL_KEY).agg(
        F.count("*").alias("n"), F.sum(invalid.cast("int")).alias("bad")
    )
    return per_key.agg(
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_signals"),
    )


def signal_transitions(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Compare each incoming signal with the symbol's last deciding signal on record.

    A rerun for the same day compares with its own earlier row: the record is taken as it is.
    """
    previous = (
        history.where("upper(signal) <> 'NO_DECISION'")
        .groupBy("symbol_key")
        .agg(F.upper(F.max_by("signal", "signal_date")).alias("previous_signal"))
    )
    changed = (
        (F.col("signal") != "NO_DECISION")
        & F.col("previous_signal").isNotNull()
        & (F.col("previous_signal") != F.col("signal"))
    )
    return incoming.join(previous, "symbol_key", "left").withColumns(
        {"signal_changed": changed, "persisted": F.col("signal") != "NO_DECISION"}
    )


def upsert_signals(history: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """Insert or replace by key; of incoming rows that repeat a key the last generated one counts. A replaced row keeps its outcomes and counts one revision up;
    NO_DECISION is never stored and stored rows with a null key are dropped."""
    old = keep_last(
        conform_history(history).dropna(subset=SIGNAL_KEY), SIGNAL_KEY, ["revision", "generated_at"]
    ).withColumn("_old", F.lit(True))
    new = keep_last(
        conform_history(incoming).where("signal <> 'NO_DECISION'"), SIGNAL_KEY, ["generated_at", "revision", "score", "signal_price", "signal"]
    ).withColumn("_new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), SIGNAL_KEY, "full_outer")
    replaced = F.col("n._new").isNotNull()
    kept = set(OUTCOME_COLUMNS)

    def pick(name: str) -> Column:
        if name in SIGNAL_KEY:
            return F.col(name)
        if name == "revision":
            bumped = F.when(F.col("o._old").isNotNull(), F.col("o.revision") + 1).otherwise(1)
            return F.when(replaced, bumped).otherwise(F.col("o.revision")).cast("int").alias(name)
        if name == "last_recalculated_at":
            return F.when(replaced, F.lit(now)).otherwise(F.col(f"o.{name}")).alias(name)
        if name in kept:
            return F.col(f"o.{name}").alias(name)
        return F.when(replaced, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return both.select(*[pick(f.name) for f in SIGNAL_HISTORY.fields])


def current_signals(history: DataFrame) -> DataFrame:
    """Latest row per symbol."""
    return keep_last(history, ["symbol_key"], ["signal_date"])


def _window_open() -> Column:
    """True when any outcome window of a row lacks its price or its return."""
    out = F.lit(False)
    for n in OUTCOME_WINDOWS:
        out = out | F.col(f"actual_price_t{n}").isNull() | F.col(f"actual_return_t{n}").isNull()
    return out


def _beside_sessions(history: DataFrame, eod: DataFrame, order: list[str]) -> DataFrame:
    """History rows with the close of the n-th session after their date, n in the outcome windows.

    History and prices are stacked and walked once per symbol: a history row learns the
    number of the last session up to its date (which need not be a session itself), and a
    range over session numbers finds session + n. One shuffle, no join, no pairs.
    """
    prices = eod.select(
        "symbol_key", F.col("date").try_cast("date").alias("_day"),
        nan_to_null(F.col("ad_close").try_cast("double")).alias("_close"), *order,
    ).dropna(subset=["_day", "_close"])
    prices = keep_last(prices, ["symbol_key", "_day"], order).drop(*order) if order else prices
    rows = history.select("symbol_key", F.col("signal_date").alias("_day"), F.struct(*history.columns).alias("_row"))
    stacked = prices.unionByName(rows, allowMissingColumns=True)
    by_day = W.partitionBy("symbol_key").orderBy("_day").rangeBetween(W.unboundedPreceding, 0)
    placed = stacked.withColumn("_session", F.count("_close").over(by_day))
    by_session = W.partitionBy("symbol_key").orderBy("_session")
    ahead = {f"_p{n}": F.max("_close").over(by_session.rangeBetween(n, n)) for n in OUTCOME_WINDOWS}
    whole = by_session.rangeBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        placed.withColumns({**ahead, "_has_eod": F.count("_close").over(whole) > 0})
        .where("_row is not null")
        .select("_row.*", "_has_eod", *ahead)
    )


def resolved_outcomes(
    history: DataFrame, eod: DataFrame, now: datetime, order: tuple[str, ...] = (),
) -> DataFrame:
    """``fill_outcomes`` with two more columns per row: ``outcome_updated`` and ``eod_missing``."""
    out = _beside_sessions(conform_history(history), eod, list(order))
    base = F.col("signal_price")
    deciding = F.col("signal") != "NO_DECISION"
    usable = deciding & base.isNotNull() & (base != 0)
    values, touched = {}, F.lit(False)
    for n in OUTCOME_WINDOWS:
        price, ret, found = f"actual_price_t{n}", f"actual_return_t{n}", F.col(f"_p{n}")
        due = F.coalesce(
            usable & (F.col(price).isNull() | F.col(ret).isNull()) & found.isNotNull(), F.lit(False)
        )
        touched = touched | due
        values[price] = F.when(due, found).otherwise(F.col(price))
        values[ret] = F.when(due, safe_div(found - base, base)).otherwise(F.col(ret))
    values["actual_updated_at"] = F.when(touched, F.lit(now)).otherwise(F.col("actual_updated_at"))
    values["outcome_updated"] = touched
    values["eod_missing"] = deciding & _window_open() & ~F.col("_has_eod")
    return out.withColumns(values).select(
        *[f.name for f in SIGNAL_HISTORY.fields], "outcome_updated", "eod_missing"
    )


def fill_outcomes(
    history: DataFrame, eod: DataFrame, now: datetime, order: tuple[str, ...] = (),
) -> DataFrame:
    """Fill the missing outcome windows from the sessions after each signal.

    Signal fields are never touched; a window already filled stays; a null or zero signal
    price, a NO_DECISION row and a symbol without EOD rows are left as they are.
    """
    return resolved_outcomes(history, eod, now, order).drop("outcome_updated", "eod_missing")


def missing_eod_symbols(resolved: DataFrame) -> DataFrame:
    """Symbols that still need outcomes but have no EOD rows, as rows: the list may grow
    with the universe."""
    return resolved.where("eod_missing").select("symbol_key").distinct()


def outcome_summary(resolved: DataFrame) -> DataFrame:
    """One row: records scanned, records updated, number of symbols without EOD rows."""
    per_symbol = resolved.groupBy("symbol_key").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("outcome_updated"), 1)).alias("updated"),
        F.max(F.col("eod_missing").cast("int")).alias("missing"),
    )
    return per_symbol.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
            for c, name in (("n", "records_scanned"), ("updated", "records_updated"), ("missing", "missing_eod_count"))
        ]
    )
