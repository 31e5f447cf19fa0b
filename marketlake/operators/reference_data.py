"""Industry hierarchy and derived statement columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlake.session import cut_lineage

__all__ = ["industry_paths", "statement_columns"]

def industry_paths(industries: DataFrame) -> DataFrame:
    """Each industry with the codes of its ancestors, root first.

    ``icb_code, parent_code`` refer to each other, to any depth. Each join walks one level up and
    is written, until no row has a parent left; a cycle raises.
    """
    out = cut_lineage(industries.withColumns({"path": F.array("icb_code"), "_up": F.col("parent_code")}))
    step = cut_lineage(industries.select(F.col("icb_code").alias("_up"), F.col("parent_code").alias("_next")))
    while out.where("_up is not null").limit(1).count():
        looped = out.where(F.array_contains("path", F.col("_up"))).select("icb_code").head()
        if looped:
            raise ValueError(f"industry {looped.icb_code} is among its own ancestors")
        out = cut_lineage(out.join(step, "_up", "left").withColumn(
            "path", F.when(F.col("_up").isNotNull(), F.concat(F.array("_up"), "path")).otherwise(F.col("path"))
        ).drop("_up").withColumnRenamed("_next", "_up"))
    return out.drop("_up").withColumns({"depth": F.size("path"), "root_code": F.col("path")[0]})


def statement_columns(statements: DataFrame) -> DataFrame:
    """``total_debt`` = short + long term debt, ``net_debt`` = total debt - cash,
    ``free_cash_flow`` = operating cash flow + purchases of fixed assets (a negative number)."""
    debt = F.col("short_term_debt") + F.col("long_term_debt")
    return statements.withColumns(
        {
            "total_debt": debt, "net_debt": debt - F.col("cash_and_equivalents"),
            "free_cash_flow": F.col("net_cash_from_operating_activities") + F.col("purchase_fixed_assets"),
        }
    )
