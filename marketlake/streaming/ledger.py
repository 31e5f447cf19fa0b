"""Streams kept as tables of batches: each batch reads what the batches before it wrote and writes its own folders.

A batch that runs again replaces its folders and reads only earlier ones, so a retry or a restart gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Window as W, functions as F

from marketlake.operators import cooldown
from marketlake.sources.datasets import file_system

__all__ = ["cooldown_batches", "parent_batches", "signal_change_batches", "signal_changes", "written"]

BatchWriter = Callable[[DataFrame, int], None]

#: Folders that a batch's children are dealt into by their parent; a batch reads those of the parents it touches.
BUCKETS = 64
_TERMINAL = ("SUCCESS", "FAILED", "ERROR")
_CHILD = "parent_log_id long, id long, status string, records_synced long, seq long, batch long, bucket int"
_SERIES = ["symbol_key", "strategy", "timeframe"]
_HELD = "symbol_key string, strategy string, timeframe string, signal_date date, signal string, batch long"
_TOLD = "symbol_key string, strategy string, timeframe string, signal_date date, previous_signal string, new_signal string, kind string, batch long"
_DATES = "latest date, held date, batch long"
_PARENT = "id long, status string, child_count long, success_count long, failed_count long, records_synced long, batch long"


def written(spark, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of one table of the ledger, of the batches below ``before``; none where nothing is written yet."""
    path = f"{root}/{name}"
    fs, hadoop_path = file_system(spark, path)
    if not fs.exists(hadoop_path(path)):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.select(*spark.createDataFrame([], schema).columns)


def _rolled(children: DataFrame) -> DataFrame:
    """Parents from all messages about their children: the first terminal status of a child counts, else its latest."""
    row = F.struct("status", "records_synced")
    closing = F.when(F.col("status").isin(*_TERMINAL), F.col("seq"))
    latest = children.groupBy("parent_log_id", "id").agg(F.coalesce(F.min_by(row, closing), F.max_by(row, "seq")).alias("x")).select("parent_log_id", "x.*")
    success, failed = F.col("status") == "SUCCESS", F.col("status").isin("FAILED", "ERROR")
    counted = latest.groupBy(F.col("parent_log_id").alias("id")).agg(
        F.count("*").alias("child_count"), F.count_if(success).alias("success_count"), F.count_if(failed).alias("failed_count"),
        F.coalesce(F.sum("records_synced"), F.lit(0)).alias("records_synced"),
    )
    opened = F.col("child_count") > F.col("success_count") + F.col("failed_count")
    return counted.select("id", F.when(opened, "RUNNING").when(F.col("failed_count") > 0, "FAILED").otherwise("SUCCESS").alias("status"), "child_count", "success_count", "failed_count", "records_synced")


def parent_batches(root: str) -> BatchWriter:
    """foreachBatch writer of parent states: ``states`` after each batch that touched them, ``completions`` once a parent.

    ``batch`` has parent_log_id, id, status, records_synced and seq (order of arrival). Touched parents are recomputed from
    all messages about their children; no child is kept in a state. A parent is complete when every child announced so far
    is closed, and what comes later changes its states but completes it no more.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash("parent_log_id"), F.lit(BUCKETS))
        rows = batch.select("parent_log_id", "id", F.upper("status").alias("status"), "records_synced", "seq", bucket.alias("bucket"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/children/batch={batch_id}")
        own = written(spark, root, "children", _CHILD).where(F.col("batch") == batch_id)
        touched = own.select("parent_log_id", "bucket").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        known = written(spark, root, "children", _CHILD, batch_id + 1).where(F.col("bucket").isin(buckets))
        states = _rolled(known.join(touched.select("parent_log_id"), "parent_log_id", "left_semi"))
        states.write.mode("overwrite").parquet(f"{root}/states/batch={batch_id}")
        now = written(spark, root, "states", _PARENT).where((F.col("batch") == batch_id) & (F.col("status") != "RUNNING"))
        done = written(spark, root, "completions", _PARENT, batch_id).select("id")
        now.join(done, "id", "left_anti").drop("batch").write.mode("overwrite").parquet(f"{root}/completions/batch={batch_id}")

    return write


def cooldown_batches(root: str, cooldown_seconds: float, key: str = "dedup_key") -> BatchWriter:
    """foreachBatch writer of retained notices (``retained``) and of each key's anchor (``anchors``).

    Only anchors pass from batch to batch; within a batch the chain is found by pointer doubling, spread by key and time.
    Notices that come after a later one was retained count as suppressed.
    """
    schema = f"`{key}` string, anchor timestamp, pending long, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        anchors = written(spark, root, "anchors", schema).where(F.col("batch") == batch_id - 1).drop("batch")
        retained, now = cooldown.after_anchors(batch.select(key, "ts", "event_id"), anchors, cooldown_seconds, key)
        retained.write.mode("overwrite").parquet(f"{root}/retained/batch={batch_id}")
        now.write.mode("overwrite").parquet(f"{root}/anchors/batch={batch_id}")
        fs, hadoop_path = file_system(spark, root)
        fs.delete(hadoop_path(f"{root}/anchors/batch={batch_id - 2}"), True)

    return write


def _walked(due: DataFrame, last: DataFrame) -> DataFrame:
    """Changes along each series (kind ``change``) and its newest signal (kind ``last``), in one sort of the released rows.

    ``last`` has the signals told before, all of earlier days. Of rows that repeat a day the last by name counts.
    """
    w = W.partitionBy(*_SERIES).orderBy("signal_date", "signal")
    told = last.select(*_SERIES, "signal_date", F.col("new_signal").alias("signal"), F.lit(True).alias("_told"))
    rows = told.unionByName(due.select(*_SERIES, "signal_date", "signal", F.lit(False).alias("_told")))
    rows = rows.withColumn("_next", F.lead("signal_date").over(w)).where("_next is null or _next <> signal_date")
    rows = rows.withColumn("previous_signal", F.lag("signal").over(w))
    change = F.when(~F.col("_told") & (F.col("previous_signal") != F.col("signal")), "change")
    kinds = F.array_compact(F.array(change, F.when(F.col("_next").isNull(), "last")))
    return rows.select(*_SERIES, "signal_date", "previous_signal", F.col("signal").alias("new_signal"), F.explode(kinds).alias("kind"))


def signal_change_batches(root: str, lateness_days: int) -> BatchWriter:
    """foreachBatch writer of the change events along each (symbol, strategy, timeframe), whatever order the rows come in.

    A row waits in ``held`` until one of ``lateness_days`` later has come and is then applied by date; a row for a day that
    an earlier batch has passed is dropped. NO_DECISION rows move time and are passed over. From batch to batch go the held rows
    and the last signal of each series; a folder of held rows goes when all of its days are passed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, day = batch.sparkSession, F.col("signal_date")
        deciding = F.col("signal") != "NO_DECISION"
        known = {r["batch"]: r for r in written(spark, root, "dates", _DATES, batch_id).collect()}  # a row a batch with held rows
        seen = known[batch_id - 1]["latest"] if batch_id - 1 in known else None
        own, held = batch.agg(F.max(day), F.max(F.when(deciding, day))).first()
        latest = max((d for d in (seen, own) if d is not None), default=None)
        if latest is None:
            return
        passed, mark = (None if d is None else d - timedelta(days=lateness_days) for d in (seen, latest))
        not_passed = F.lit(True) if passed is None else day > F.lit(passed)
        batch.where(deciding & not_passed).select(*_SERIES, "signal_date", "signal").write.mode("overwrite").parquet(f"{root}/held/batch={batch_id}")
        due = written(spark, root, "held", _HELD, batch_id + 1).where(not_passed & (day <= F.lit(mark)))
        last = written(spark, root, "told", _TOLD).where((F.col("batch") == batch_id - 1) & (F.col("kind") == "last"))
        _walked(due, last).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{root}/told/batch={batch_id}")
        spark.createDataFrame([(latest, held)], "latest date, held date").coalesce(1).write.mode("overwrite").parquet(f"{root}/dates/batch={batch_id}")
        fs, hadoop_path = file_system(spark, root)
        over = [n for n, r in known.items() if n < batch_id - 1 and (r["held"] is None or (passed is not None and r["held"] <= passed))]
        for old in [f"told/batch={batch_id - 2}/kind=last"] + [f"{name}/batch={n}" for n in over for name in ("held", "dates")]:
            fs.delete(hadoop_path(f"{root}/{old}"), True)

    return write


def signal_changes(spark, root: str) -> DataFrame:
    """The change events that :func:`signal_change_batches` has written, with their batch."""
    return written(spark, root, "told", _TOLD).where("kind = 'change'").drop("kind")
