"""Queries over stored datasets: written, replaced, refused, published and read back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from marketlake.operators import governance as gov
from marketlake.operators.history import CANONICAL_ORDER
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.registry import big, query
from marketlake.session import checkpoint_dir, cut_lineage
from marketlake.sources import datasets as ds, fixtures

_NOW = datetime(2026, 1, 1)  # one clock value for all publications of a query
_MARKETS = ("hose", "hnx", "upcom")


define("listed", "SELECT exchange, e.* FROM eod e JOIN symbols USING (code)", "eod", "symbols")


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/marketlake-{uuid.uuid4().hex}"


def _refuse(df: DataFrame) -> None:
    raise ValueError(f"refused: {df.columns}")


def _fails(step) -> bool:
    try:
        step()
    except ValueError:
        return True
    return False


def _published(spark, sf_dir) -> str:
    """Bars by market; HNX corrected within the same second, a correction of UPCOM refused."""
    root, bars = _folder(spark), cut_lineage(fixtures.eod(spark, sf_dir))
    for market in _MARKETS:
        of_market = bars.where(F.lower("exchange") == market).drop("exchange")
        ds.publish(of_market, root, "eod", {"exchange": market}, _NOW, order_by=["code", "date"])
        if market != "hose":
            twice = of_market.withColumn("nm_volume", F.col("nm_volume") * 2)
            check = _refuse if market == "upcom" else None
            refused = _fails(lambda: ds.publish(twice, root, "eod", {"exchange": market}, _NOW, validate=check))
            if refused != (market == "upcom"):
                raise AssertionError(f"publication of {market}: refused is {refused}")
    return root


@query("published_eod", with_ctes("""
SELECT lower(exchange) exchange, code, date, ad_close, (CASE exchange WHEN 'HNX' THEN 2 ELSE 1 END * nm_volume)::double nm_volume,
  CASE exchange WHEN 'HOSE' THEN 1 WHEN 'HNX' THEN 3 ELSE 4 END::bigint publication FROM listed""", "listed"))
def published_eod(spark, sf_dir):
    return ds.read_published(spark, _published(spark, sf_dir), "eod", [{"exchange": m} for m in _MARKETS]).select(
        "exchange", "code", "date", "ad_close", F.col("nm_volume").cast("double").alias("nm_volume"), "publication"
    )


@query("published_manifests", with_ctes("""
SELECT p.publication::bigint publication, lower(exchange) exchange, 'READY' status, n row_count, 8::bigint column_count,
  strftime(first, '%Y-%m-%dT00:00:00') min_timestamp, strftime(last, '%Y-%m-%dT00:00:00') max_timestamp, p.current, '' violations
FROM (SELECT exchange, count(*)::bigint n, min(date) first, max(date) last FROM listed GROUP BY exchange) e
JOIN (VALUES ('HOSE', 1, true), ('HNX', 2, false), ('HNX', 3, true), ('UPCOM', 4, true)) p(market, publication, current) ON p.market = e.exchange""", "listed"))
def published_manifests(spark, sf_dir):
    """Every publication with whether it is the current one, and the contract rules that its manifest breaks."""
    manifests = gov.manifest_violations(ds.read_manifests(spark, _published(spark, sf_dir), "eod"))
    current = gov.latest_ready(manifests).select("publication", F.lit(True).alias("current"))
    return manifests.join(current, "publication", "left").select(
        "publication", F.col("partition")["exchange"].alias("exchange"), "status", F.col("rowCount").alias("row_count"),
        F.col("columnCount").alias("column_count"), F.col("minTimestamp").alias("min_timestamp"), F.col("maxTimestamp").alias("max_timestamp"),
        F.coalesce("current", F.lit(False)).alias("current"), F.array_join("violations", ",").alias("violations"),
    )


@query("stored_history", with_ctes("""
SELECT strategy, '1d' timeframe, exchange, exchange || '-' || code symbol_key, date signal_date, CASE WHEN n_trades > 1 THEN 'BUY' ELSE 'SELL' END signal,
  CASE WHEN exchange = 'HNX' THEN 2 ELSE 1 END::bigint revision
FROM listed, (SELECT unnest(['S1', 'S2']) strategy) WHERE exchange IN ('HOSE', 'HNX') AND (exchange <> 'HNX' OR date >= DATE '1995-01-01')""", "listed"))
def stored_history(spark, sf_dir):
    """A history written by market: absent at first, then whole; one market overwritten by a rerun; a refused replacement
    changes nothing; two members are read back in one pruned scan."""
    path = f"{_folder(spark)}/signal_history"
    if ds.read_optional(spark, path) is not None:
        raise AssertionError("a new dataset is there already")
    bars = cut_lineage(fixtures.eod(spark, sf_dir))
    rows = bars.select(
        F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("strategy"), F.lit("1d").alias("timeframe"), "exchange",
        F.concat_ws("-", "exchange", "code").alias("symbol_key"), F.col("date").alias("signal_date"),
        F.when(F.col("n_trades") > 1, "BUY").otherwise("SELL").alias("signal"), F.lit(1).alias("revision"),
    )
    ds.replace_dataset(rows, path, validate=_whole(rows.columns), partition_by=["exchange"], order_by=CANONICAL_ORDER)
    rerun = rows.where("exchange = 'HNX' and signal_date >= date'1995-01-01'").withColumn("revision", F.lit(2))
    ds.write_dataset(rerun, path, partition_by=["exchange"], order_by=CANONICAL_ORDER)
    if not _fails(lambda: ds.replace_dataset(rows.limit(1), path, validate=_refuse)):
        raise AssertionError("a refused replacement went through")
    return ds.gather(ds.read_dataset(spark, path), "exchange", ["HOSE", "HNX"]).select(
        "strategy", "timeframe", "exchange", "symbol_key", "signal_date", "signal", big("revision")
    )


def _whole(columns):
    def check(df: DataFrame) -> None:
        if set(df.columns) != set(columns) or df.where("symbol_key is null or signal_date is null").limit(1).count():
            raise ValueError("rows without a key")

    return check
