"""Streams run over whole tables; each has the same SQL twin as its batch form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlake.functions.keyed import keep_last
from marketlake.operators import commands, signals
from marketlake.plans import job_queries, signal_queries
from marketlake.plans.ctes import with_ctes
from marketlake.plans.registry import query, rnd
from marketlake.session import fit_shuffles
from marketlake.sources import fixtures
from marketlake.streaming import jobs, ledger, runs, ticks


@query("status_stream", with_ctes("""
SELECT a.execution_id, CASE WHEN a.status = 'ERROR' THEN 'FAILED' ELSE a.status END status, a.seq
FROM cuts c JOIN accepted a ON a.execution_id = c.execution_id AND a.seq = c.cut""", "cuts"))
def status_stream(spark, sf_dir):
    """First terminal status wins, kept as keyed state."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "RUNNING").when(kind == "click", "PENDING").when(kind == "purchase", "SUCCESS")
        .when(kind == "error", "ERROR").otherwise("PARTIAL_SUCCESS")
    )
    messages = runs.table_stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("execution_id"), status.alias("status")
    )
    changes = runs.drained(jobs.status_stream_state(messages), "update")
    return changes.groupBy("execution_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


@query("cooldown_stream", with_ctes("""
SELECT c.dedup_key, e.event_id, coalesce(c.rn - lag(c.rn) OVER w - 1, 0)::bigint delivered_suppressed
FROM chain c JOIN chain_events e ON e.dedup_key = c.dedup_key AND e.rn = c.rn WINDOW w AS (PARTITION BY c.dedup_key ORDER BY c.rn)""", "chain"))
def cooldown_stream(spark, sf_dir):
    """Events in four files by time, one a batch; only anchors pass from batch to batch."""
    severity = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    notices = fixtures.load(spark, sf_dir, "events").select(
        F.concat(severity, F.lit("|"), F.col("event_type")).alias("dedup_key"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )
    at = F.unix_micros("ts")
    cuts = notices.select(at.cast("double").alias("t")).approxQuantile("t", [0.33, 0.66], 0.01)
    third = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    out = runs.fed_in_parts([notices.where(third == k) for k in range(3)], lambda root: ledger.cooldown_batches(root, 6 * 3600))
    return ledger.written(spark, out, "retained", "dedup_key string, event_id long, delivered_suppressed long")


@query("parent_stream", with_ctes("""
SELECT id, CASE WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCESS' END status, n::bigint child_count, success::bigint success_count, failed::bigint failed_count,
  synced::bigint records_synced, 1::bigint completions
FROM (SELECT parent_log_id id, count(*) n, count(*) FILTER (WHERE status = 'SUCCESS') success, count(*) FILTER (WHERE status = 'FAILED') failed, sum(records_synced) synced
  FROM finished GROUP BY parent_log_id) WHERE n = success + failed""", "finished"))
def parent_stream(spark, sf_dir):
    """Children are announced, then report in two parts, some again; the stream is started anew for each part."""
    children = job_queries.child_runs(spark, sf_dir).select("parent_log_id", "id", "status", "records_synced")
    announced = children.select("parent_log_id", "id", F.lit("PENDING").alias("status"), F.lit(0).cast("bigint").alias("records_synced"), F.col("id").alias("seq"))
    told = children.withColumn("seq", F.col("id") + 2**40)
    # children that are closed already report a failure, which changes nothing
    again = told.where("id % 6 = 0 and status in ('SUCCESS', 'FAILED')").select("parent_log_id", "id", F.lit("FAILED").alias("status"), (F.col("records_synced") + 1).alias("records_synced"), (F.col("seq") + 2**40).alias("seq"))
    parts = [announced, told.where("id % 2 = 0"), told.where("id % 2 = 1").union(again)]
    out = runs.fed_in_parts(parts, ledger.parent_batches)
    found = ledger.written(spark, out, "completions", "id long, status string, child_count long, success_count long, failed_count long, records_synced long")
    return found.groupBy(*found.columns).agg(F.count("*").alias("completions"))


@query("signal_change_stream", with_ctes("""
SELECT symbol_key, signal_date, previous_signal, signal new_signal FROM (
  SELECT *, lag(signal) OVER (PARTITION BY symbol_key ORDER BY signal_date) previous_signal FROM deciding) WHERE previous_signal <> signal""", "deciding"))
def signal_change_stream(spark, sf_dir):
    """Scored rows in eight shuffled parts, one a batch, and at the end a row that moves time past them.

    A part has as many files as the trades ask for, so that neither its writing nor its reading is the work of one task.
    """
    rows = signal_queries.scored(spark, sf_dir).select("symbol_key", "strategy", "timeframe", "signal_date", "signal")
    base, wanted = runs.new_folder(spark), fit_shuffles(spark, f"{sf_dir}/lineitem.parquet")
    rows.repartition(max(8, wanted), F.xxhash64("symbol_key", "signal_date")).write.parquet(f"{base}/in")
    files = -(-len(spark.read.schema(rows.schema).parquet(f"{base}/in").inputFiles()) // 8)
    closing = [("-", signals.STRATEGY, "1d", date(2200, 1, 1), "NO_DECISION")]
    spark.createDataFrame(closing, rows.schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    runs.run_batches(runs.folder_stream(spark, f"{base}/in", rows.schema, files), ledger.signal_change_batches(f"{base}/out", 20000), f"{base}/progress")
    return ledger.signal_changes(spark, f"{base}/out").select("symbol_key", "signal_date", "previous_signal", "new_signal")


_KINDS_SQL = ", ".join(f"'{k}'" for k in commands.KINDS)


@query("command_stream", f"""
WITH told AS (SELECT *, [{_KINDS_SQL}][1 + o_orderkey % 8] kind, o_totalprice price, o_orderpriority prio FROM orders),
checked AS (SELECT *, concat_ws(', ',
  CASE WHEN prio = '3-MEDIUM' THEN 'TIMEFRAME_UNKNOWN' WHEN prio = '5-LOW' THEN 'TIMEFRAME_NOT_ENABLED' END,
  CASE WHEN kind IN ('indicators', 'signals', 'symbol_features') AND price < 20000 THEN 'SYMBOL_KEY_INVALID' END,
  CASE WHEN kind = 'signal_evaluation' AND price < 30000 THEN 'EXCHANGE_REQUIRED' END,
  CASE WHEN kind = 'indicators' AND price <= 200000 THEN 'INDICATOR_SOURCE_REQUIRED' END,
  CASE WHEN kind = 'indicators' AND o_orderstatus <> 'F' THEN 'INDICATORS_UNSUPPORTED' END,
  CASE WHEN kind IN ('signals', 'signal_evaluation') AND o_orderstatus <> 'P' OR kind = 'rotation_backtest' AND o_orderstatus <> 'O'
    OR kind IN ('sector_transition', 'transition_outcomes') AND o_orderstatus <> 'F' THEN 'STRATEGY_UNSUPPORTED' END,
  CASE WHEN kind = 'sector_features' AND price < 30000 THEN 'SECTOR_CODE_REQUIRED' END,
  CASE WHEN kind IN ('sector_features', 'rotation_backtest', 'sector_transition', 'transition_outcomes') AND prio = '2-HIGH' THEN 'SECTOR_LEVEL_INVALID' END,
  CASE WHEN kind IN ('rotation_backtest', 'sector_transition', 'transition_outcomes') AND price < 20000 THEN 'SECTOR_CODES_REQUIRED' END,
  CASE WHEN kind IN ('sector_transition', 'transition_outcomes') AND price > 300000 AND price <= 450000 THEN 'FOCUS_OUTSIDE_SECTOR_CODES' END,
  CASE WHEN kind IN ('sector_transition', 'transition_outcomes') AND prio = '1-URGENT' THEN 'HORIZONS_INVALID' END,
  CASE WHEN kind IN ('sector_transition', 'transition_outcomes') AND o_custkey % 5 = 0 THEN 'EVALUATION_DATE_INVALID' END) broken FROM told)
SELECT CASE WHEN price < 9000 THEN 'malformed' WHEN broken = '' THEN 'commands' ELSE 'errors' END sink,
  CASE WHEN price >= 9000 THEN 'E' || o_orderkey END execution_id,
  CASE WHEN price < 5000 THEN '[1, 2]' WHEN price < 9000 THEN '{{broken' WHEN broken = '' THEN kind ELSE broken END detail FROM checked""")
def command_stream(spark, sf_dir):
    """Payloads of all kinds through one stream into three sinks, read back."""
    base = runs.new_folder(spark)
    payloads = job_queries.all_commands(spark, sf_dir)
    payloads.write.parquet(f"{base}/in")
    stream = jobs.decoded_commands(runs.folder_stream(spark, f"{base}/in", payloads.schema))
    runs.run_batches(stream, jobs.route_commands(f"{base}/out"), f"{base}/progress")

    def sink(name: str, execution_id: str, detail: str):
        rows = spark.read.schema("executionId string, kind string, errorMessage string, value string").json(f"{base}/out/{name}")
        return rows.selectExpr(f"'{name}' sink", f"{execution_id} execution_id", f"{detail} detail")

    return sink("commands", "executionId", "kind").union(sink("errors", "executionId", "errorMessage")).union(sink("malformed", "cast(null as string)", "value"))


@query("minute_bar_stream", with_ctes("""
SELECT symbol, strftime(bar_time, '%Y-%m-%d %H:%M') bar_time, "open", high, low, "close", volume, round(vwap, 6) vwap, trades::bigint trades FROM bars_1""", "bars_1"))
def minute_bar_stream(spark, sf_dir):
    """All bars: the last state of each, those still open at the end of the data included."""
    trades = runs.table_stream(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("market_timestamp"),
        F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"),
    )
    bars = runs.drained(ticks.minute_bar_stream(trades), "update")
    return keep_last(bars, ["symbol", "bar_time"], ["batch"]).select(
        "symbol", F.date_format("bar_time", "yyyy-MM-dd HH:mm").alias("bar_time"), "open", "high", "low", "close", "volume", rnd("vwap"), "trades"
    )
