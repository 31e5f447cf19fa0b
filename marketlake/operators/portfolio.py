"""Portfolio positions from transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

__all__ = ["positions", "with_total_amount"]

# How a transaction type moves the holding and the cash.
ADDS = ["BUY", "STOCK_DIVIDEND", "RIGHTS", "TRANSFER_IN"]
REMOVES = ["SELL", "TRANSFER_OUT"]
PAYS = ["BUY", "RIGHTS", "CASH_OUT"]
RECEIVES = ["SELL", "DIVIDEND", "CASH_IN"]
_MONEY = "decimal(20,4)"


def with_total_amount(transactions: DataFrame) -> DataFrame:
    """total_amount = quantity * price + fee + tax, in decimals."""
    q, p, fee, tax = (F.col(c).cast(_MONEY) for c in ("quantity", "price", "fee", "tax"))
    return transactions.withColumn("total_amount", (q * p + fee + tax).cast("decimal(38,4)"))


def positions(transactions: DataFrame) -> DataFrame:
    """Holding and cash balance after each day, per portfolio and symbol.

    Days are summed first (on the map side as well), so a busy account reaches the running
    window as one row per symbol and day. What is paid includes fee and tax, what is
    received has them deducted.
    """
    kind, q = F.col("type"), F.col("quantity").cast("bigint")
    costs = F.col("fee").cast(_MONEY) + F.col("tax").cast(_MONEY)
    gross = (F.col("total_amount") - costs).cast("decimal(38,4)")
    moved = F.when(kind.isin(ADDS), q).when(kind.isin(REMOVES), -q).otherwise(0)
    cash = F.when(kind.isin(PAYS), -F.col("total_amount")).when(kind.isin(RECEIVES), (gross - costs).cast("decimal(38,4)")).otherwise(0)
    keys = ["portfolio_id", "symbol"]
    days = with_total_amount(transactions).groupBy(*keys, "txn_date").agg(
        F.sum(moved).alias("net_quantity"), F.sum(cash).cast("decimal(38,4)").alias("net_cash"), F.count("*").alias("transactions")
    )
    so_far = W.partitionBy(*keys).orderBy("txn_date").rowsBetween(W.unboundedPreceding, 0)
    return days.withColumns(
        {"position": F.sum("net_quantity").over(so_far), "cash_flow": F.sum("net_cash").over(so_far).cast("decimal(38,4)")}
    )
