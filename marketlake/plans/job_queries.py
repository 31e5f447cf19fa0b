"""Queries over commands, executions, notices, manifests and dependencies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marketlake.functions.text import normalized_title
from marketlake.operators import commands, cooldown, executions as ex, governance as gov
from marketlake.plans.ctes import define, with_ctes
from marketlake.plans.registry import big, query
from marketlake.sources import fixtures, manifests as mf

_NOW = datetime(2001, 9, 1)


def _command_rows(spark, sf_dir):
    """One JSON command per order; every rule is broken by some of them."""
    o = fixtures.load(spark, sf_dir, "orders")
    status, prio, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    fields = F.struct(
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("executionId"),
        F.when(price < 20000, "HOSE").otherwise(F.concat(F.lit("HOSE-S"), F.col("o_custkey").cast("string"))).alias("symbolKey"),
        F.when(prio == "5-LOW", "5m").when(prio == "3-MEDIUM", "2d").otherwise("1d").alias("timeframe"),
        F.when(status == "P", "trend_momentum_v1").otherwise("OTHER").alias("strategy"),
        F.lit("ad_close").alias("indicatorSource"),
        F.when(status == "F", F.array(F.lit("ma20"), F.lit("RSI14"))).otherwise(F.array(F.lit("EMA9"))).alias("indicators"),
        F.when(price > 400000, F.array(F.lit(" asia "), F.lit("EUROPE"), F.lit("Asia"), F.lit(" "))).otherwise(F.array(F.lit("AFRICA"))).alias("sectorCodes"),
        F.when(price > 450000, F.array(F.lit("asia"))).when(price > 300000, F.array(F.lit("MARS"))).alias("focusSectorCodes"),
    )
    kind = F.when(F.col("o_custkey") < 100, "indicators").otherwise("signals")
    text = F.when(price < 5000, F.lit("[1, 2]")).when(price < 9000, F.lit("{broken")).otherwise(F.to_json(fields))
    return o.select("o_orderkey", kind.alias("kind"), text.alias("value"))


def all_commands(spark, sf_dir):
    """One JSON command of some kind per order; every rule of every kind is broken by some of them."""
    o = fixtures.load(spark, sf_dir, "orders")
    status, prio, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    blank_below = lambda limit, text: F.when(price < limit, " ").otherwise(text)
    fields = F.struct(
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("executionId"),
        F.when(price < 20000, "HOSE").otherwise(F.concat(F.lit("HOSE-S"), F.col("o_custkey").cast("string"))).alias("symbolKey"),
        F.when(prio == "5-LOW", "5m").when(prio == "3-MEDIUM", "2d").otherwise("1d").alias("timeframe"),
        F.when(status == "P", "trend_momentum_v1").when(status == "O", "SECTOR_WAVE_V1").otherwise(" sector_transition_v1").alias("strategy"),
        F.when(price > 200000, "ad_close").alias("indicatorSource"),
        F.when(status == "F", F.array(F.lit("ma20"), F.lit("RSI14"))).otherwise(F.array(F.lit("EMA9"))).alias("indicators"),
        F.when(price > 400000, F.array(F.lit(" asia "), F.lit("Asia"), F.lit(" "))).when(price < 20000, F.array().cast("array<string>")).otherwise(F.array(F.lit("AFRICA"))).alias("sectorCodes"),
        F.when(price > 450000, F.array(F.lit("asia"))).when(price > 300000, F.array(F.lit("MARS"))).alias("focusSectorCodes"),
        blank_below(30000, "HOSE").alias("exchange"), blank_below(30000, "ASIA").alias("sectorCode"),
        F.when(prio == "2-HIGH", 0).otherwise(1).alias("sectorLevel"),
        F.when(prio == "1-URGENT", F.array(F.lit(5), F.lit(0))).otherwise(F.array(F.lit(5), F.lit(10))).alias("predictionHorizons"),
        F.when(F.col("o_custkey") % 5 == 0, "soon").otherwise("1998-01-05").alias("evaluationDate"),
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in commands.KINDS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    text = F.when(price < 5000, F.lit("[1, 2]")).when(price < 9000, F.lit("{broken")).otherwise(F.to_json(fields))
    return o.select(kind.alias("kind"), text.alias("value"))


@query("decode_job_payload", """
SELECT o_orderkey, o_totalprice < 9000 malformed, CASE WHEN o_totalprice >= 9000 THEN 'E' || o_orderkey END execution_id,
  CASE WHEN o_totalprice < 9000 THEN NULL WHEN o_totalprice < 20000 THEN 'HOSE' ELSE 'HOSE-S' || o_custkey END symbol_key,
  CASE WHEN o_totalprice < 9000 THEN NULL WHEN o_orderstatus = 'F' THEN 'ma20,RSI14' ELSE 'EMA9' END indicators FROM orders""")
def decode_job_payload(spark, sf_dir):
    return commands.decode_json(_command_rows(spark, sf_dir)).select(
        "o_orderkey", "malformed", F.col("executionId").alias("execution_id"), F.col("symbolKey").alias("symbol_key"),
        F.array_join("indicators", ",").alias("indicators"),
    )


@query("validate_commands", """
SELECT o_orderkey, kind, concat_ws(',', CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'TIMEFRAME_UNKNOWN' WHEN o_orderpriority = '5-LOW' THEN 'TIMEFRAME_NOT_ENABLED' END,
  CASE WHEN o_totalprice < 20000 THEN 'SYMBOL_KEY_INVALID' END, CASE WHEN kind = 'indicators' AND o_orderstatus <> 'F' THEN 'INDICATORS_UNSUPPORTED' END,
  CASE WHEN kind = 'signals' AND o_orderstatus <> 'P' THEN 'STRATEGY_UNSUPPORTED' END) violations
FROM (SELECT *, CASE WHEN o_custkey < 100 THEN 'indicators' ELSE 'signals' END kind FROM orders WHERE o_totalprice >= 9000)""")
def validate_commands(spark, sf_dir):
    decoded = commands.decode_json(_command_rows(spark, sf_dir)).where("not malformed")
    return commands.validated(decoded).select("o_orderkey", "kind", F.array_join("violations", ",").alias("violations"))


@query("normalize_code_lists", """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'ASIA,EUROPE' ELSE 'AFRICA' END codes,
  CASE WHEN o_totalprice > 450000 THEN 'ASIA' WHEN o_totalprice > 300000 THEN 'MARS' WHEN o_totalprice > 400000 THEN 'ASIA,EUROPE' ELSE 'AFRICA' END focus,
  CASE WHEN o_totalprice > 300000 AND o_totalprice <= 450000 THEN 'MARS' ELSE '' END focus_outside FROM orders WHERE o_totalprice >= 9000""")
def normalize_code_lists(spark, sf_dir):
    decoded = commands.decode_json(_command_rows(spark, sf_dir)).where("not malformed")
    lists = commands.code_lists(decoded)
    return lists.select(
        "o_orderkey", F.array_join("sectorCodes", ",").alias("codes"), F.array_join("focusSectorCodes", ",").alias("focus"),
        F.array_join("focus_outside", ",").alias("focus_outside"),
    )


@query("job_status_records", """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'HOSE-S' || o_custkey END symbol_key, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'PARTIAL_SUCCESS' ELSE 'ERROR' END status,
  o_orderkey::varchar execution_id, floor(o_totalprice)::bigint records, ((o_orderkey % 100) * 1500)::bigint duration_ms FROM orders""")
def job_status_records(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    work = fixtures.load(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("HOSE-S"), F.col("o_custkey").cast("string"))).alias("symbolKey"),
        F.col("o_orderkey").cast("string").alias("executionId"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", " partial_success").otherwise("ERROR").alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("records_inserted"), F.lit(0).alias("total_records"),
        F.lit(None).cast("string").alias("new_offset"), F.lit(None).cast("string").alias("error_message"),
        start.alias("startedAt"), F.timestamp_millis(F.unix_millis(start) + (F.col("o_orderkey") % 100) * 1500).alias("finishedAt"),
    )
    return commands.status_records(work).select(
        F.col("symbolKey").alias("symbol_key"), "status", F.col("executionId").alias("execution_id"),
        F.col("recordsProcessed").alias("records"), F.col("durationMs").alias("duration_ms"),
    )


define("execs", """
SELECT o_orderkey id, o_custkey parent_log_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'PENDING' ELSE
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' ELSE 'RUNNING' END END status, o_orderdate::date started_on, floor(o_totalprice)::bigint records_synced FROM orders""")
define("finished", """
SELECT * REPLACE (CASE WHEN status IN ('PENDING', 'RUNNING') AND started_on >= DATE '1996-01-01' THEN 'SUCCESS' ELSE status END AS status) FROM execs""", "execs")
define("rolled", """
SELECT c_custkey id, c_acctbal < 0 closed, count(e.id) n, count(*) FILTER (WHERE status = 'SUCCESS') success, count(*) FILTER (WHERE status = 'FAILED') failed,
  count(*) FILTER (WHERE status IN ('PENDING', 'RUNNING')) open, min(started_on) first_start, max(started_on) last_finish, coalesce(sum(records_synced), 0) synced
FROM customer LEFT JOIN finished e ON e.parent_log_id = c_custkey GROUP BY c_custkey, c_acctbal""", "finished")
define("parent_state", """
SELECT *, CASE WHEN closed THEN 'FAILED' WHEN n = 0 THEN 'SUCCESS' WHEN open > 0 THEN 'RUNNING' WHEN failed > 0 THEN 'FAILED' ELSE 'SUCCESS' END status FROM rolled""", "rolled")


def child_runs(spark, sf_dir):
    """All executions; those still open of the later years count as done, so that some parents close."""
    late = F.col("status").isin("PENDING", "RUNNING") & (F.col("started_on") >= F.lit("1996-01-01").cast("date"))
    rows = fixtures.executions(spark, sf_dir).withColumn("status", F.when(late, "SUCCESS").otherwise(F.col("status")))
    at = F.col("started_on").cast("timestamp")
    return rows.withColumns({"started_at": at, "finished_at": F.when(F.col("status").isin("SUCCESS", "FAILED"), at)})


def _rolled(spark, sf_dir):
    parents = fixtures.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "FAILED").otherwise("PENDING").alias("status"),
        F.col("c_name").alias("title"),
    )
    return ex.rollup(parents, child_runs(spark, sf_dir), _NOW)


@query("execution_rollup", with_ctes("""
SELECT id, status, CASE WHEN closed THEN 0 ELSE synced END::bigint records_synced, CASE WHEN NOT closed AND status = 'FAILED' THEN failed || '/' || n || ' tasks failed' END error,
  CASE WHEN NOT closed THEN strftime(first_start, '%Y-%m-%d') END first_start,
  CASE WHEN NOT closed AND n = 0 THEN '2001-09-01' WHEN NOT closed AND open = 0 THEN strftime(last_finish, '%Y-%m-%d') END last_finish,
  n::bigint child_count, success::bigint success_count, failed::bigint failed_count FROM parent_state""", "parent_state"))
def execution_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir).select(
        "id", "status", F.coalesce("records_synced", F.lit(0)).alias("records_synced"), "error",
        F.date_format("started_at", "yyyy-MM-dd").alias("first_start"), F.date_format("finished_at", "yyyy-MM-dd").alias("last_finish"),
        "child_count", "success_count", "failed_count",
    )


@query("execution_notices", with_ctes("""
SELECT id, CASE WHEN status = 'SUCCESS' THEN 'INFO' ELSE 'ERROR' END severity,
  CASE WHEN status = 'SUCCESS' THEN 'Job completed: ' ELSE 'Job failed: ' END || c_name title,
  CASE WHEN n > 0 AND status = 'SUCCESS' THEN success || '/' || n || ' tasks completed successfully' WHEN n > 0 THEN failed || '/' || n || ' tasks failed'
    WHEN status = 'SUCCESS' THEN 'Job completed successfully' ELSE 'Job failed' END message
FROM parent_state JOIN customer ON c_custkey = id WHERE status IN ('SUCCESS', 'FAILED')""", "parent_state"))
def execution_notices(spark, sf_dir):
    return ex.execution_notices(_rolled(spark, sf_dir))


@query("transition_failure_notices", with_ctes("""
SELECT p.id, 'Focus: ASIA' || chr(10) || 'Evaluation date: ' || coalesce(strftime(f.started_on, '%Y-%m-%d'), 'UNKNOWN') || chr(10) || 'Timeframe: 1d' || chr(10) || 'Strategy: UNKNOWN'
  || chr(10) || 'Horizons: T1, T5' || chr(10) || chr(10) || 'Reason:' || chr(10) || coalesce('run ' || f.id || ' failed', 'Sector Transition analysis failed') || chr(10) || chr(10)
  || 'Progress: ' || success || ' succeeded / ' || failed || ' failed' message
FROM parent_state p LEFT JOIN (SELECT parent_log_id, min(id) id, min_by(started_on, id) started_on FROM finished WHERE status = 'FAILED' GROUP BY parent_log_id) f ON f.parent_log_id = p.id
WHERE p.status = 'FAILED' AND (f.id IS NOT NULL OR closed)""", "parent_state"))
def transition_failure_notices(spark, sf_dir):
    pairs = lambda *kv: F.create_map(*[x if i % 2 else F.lit(x) for i, x in enumerate(kv)])
    children = child_runs(spark, sf_dir).withColumns(
        {
            "seq": F.col("id"),
            "meta": pairs("evaluationDate", F.date_format("started_on", "yyyy-MM-dd"), "errorMessage",
                          F.concat(F.lit("run "), F.col("id").cast("string"), F.lit(" failed"))),
        }
    )
    parents = _rolled(spark, sf_dir).drop("error").withColumns(
        {"error": F.lit(None).cast("string"),
         "meta": pairs("sectorCodes", F.lit("ASIA"), "timeframe", F.lit("1d"), "predictionHorizons", F.lit("1, 5"))}
    )
    return ex.transition_failure_notices(parents, children).select("id", "message")


@query("signal_digest", with_ctes("""
SELECT p.id, total::bigint total_children, changed::bigint changed_count, changed || ' signal change(s) detected for strategy TREND_MOMENTUM_V1 on timeframe UNKNOWN.' || chr(10) || listed
  || CASE WHEN changed > 20 THEN chr(10) || '...' || (changed - 20) || ' more changes omitted' ELSE '' END message
FROM (SELECT id FROM parent_state WHERE status = 'SUCCESS') p JOIN (
  SELECT parent_log_id id, count(*) total, count(*) FILTER (WHERE chg) changed,
    string_agg('- S' || id || ': BASELINE -> BULLISH @ ' || records_synced || ' (no date, score=n/a)', chr(10) ORDER BY id) FILTER (WHERE chg AND rn <= 20) listed
  FROM (SELECT *, status = 'SUCCESS' AND records_synced > 50000 chg, row_number() OVER (PARTITION BY parent_log_id, status = 'SUCCESS' AND records_synced > 50000 ORDER BY id) rn FROM finished)
  GROUP BY parent_log_id) c USING (id) WHERE changed > 0""", "parent_state"))
def signal_digest(spark, sf_dir):
    meta = F.create_map(
        F.lit("signalChanged"), F.when(F.col("records_synced") > 50000, "true").otherwise("false"),
        F.lit("symbolKey"), F.concat(F.lit("S"), F.col("id").cast("string")), F.lit("newSignal"), F.lit("BULLISH"),
        F.lit("price"), F.col("records_synced").cast("string"), F.lit("strategy"), F.lit("TREND_MOMENTUM_V1"),
    )
    children = child_runs(spark, sf_dir).withColumns({"seq": F.col("id"), "meta": meta})
    return ex.signal_digest(_rolled(spark, sf_dir), children).select("id", "total_children", "changed_count", "message")


define("statuses", """
SELECT event_id seq, 'E' || user_id execution_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS'
  WHEN 'error' THEN 'ERROR' ELSE 'PARTIAL_SUCCESS' END status, json_extract_string(props, '$.k') k FROM events""")
define("known_execs", "SELECT 'E' || c_custkey id, CASE WHEN c_acctbal < 0 THEN 'FAILED' ELSE 'PENDING' END status FROM customer")
define("accepted", "SELECT * FROM statuses WHERE status <> 'PARTIAL_SUCCESS'", "statuses")
define("cuts", """
SELECT execution_id, coalesce(min(seq) FILTER (WHERE status IN ('SUCCESS', 'ERROR')), max(seq)) cut FROM accepted GROUP BY execution_id""", "accepted")


def _known(spark, sf_dir):
    return fixtures.load(spark, sf_dir, "customer").select(
        F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_acctbal") < 0, "FAILED").otherwise("PENDING").alias("status"),
        F.create_map(F.lit("k"), F.lit("start"), F.lit("origin"), F.lit("stored")).alias("meta"),
    )


def _statuses(spark, sf_dir):
    props = fixtures.load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("k"))
    return fixtures.status_stream(spark, sf_dir).join(props, "seq").withColumn("meta", F.create_map(F.lit("k"), F.col("k"))).drop("k")


@query("status_apply", with_ctes("""
SELECT id, CASE WHEN e.status = 'FAILED' OR a.seq IS NULL THEN e.status WHEN a.status = 'ERROR' THEN 'FAILED' ELSE a.status END status,
  CASE WHEN e.status = 'FAILED' OR a.seq IS NULL THEN -1 ELSE a.seq END::bigint applied_seq,
  CASE WHEN e.status = 'FAILED' OR a.seq IS NULL THEN 'start' ELSE a.k END k
FROM known_execs e LEFT JOIN cuts c ON c.execution_id = e.id LEFT JOIN accepted a ON a.execution_id = e.id AND a.seq = c.cut""", "known_execs", "cuts"))
def status_apply(spark, sf_dir):
    out = ex.apply_statuses(_statuses(spark, sf_dir), _known(spark, sf_dir), id_pattern=None)
    return out.select("id", "status", F.coalesce("applied_seq", F.lit(-1)).alias("applied_seq"), F.col("meta")["k"].alias("k"))


@query("status_enriched", with_ctes("""
SELECT e.id, CASE WHEN e.status = 'FAILED' OR c.cut IS NULL THEN e.status WHEN d.status = 'ERROR' THEN 'FAILED' ELSE d.status END status,
  CASE WHEN e.status <> 'FAILED' AND c.cut IS NOT NULL THEN CASE d.seq % 3 WHEN 0 THEN d.seq % 1000 WHEN 1 THEN d.seq % 77 ELSE 0 END END::bigint records_synced,
  CASE WHEN e.status <> 'FAILED' THEN m.symbol_key END symbol_key, CASE WHEN e.status <> 'FAILED' AND c.cut IS NOT NULL THEN e.id END execution_id,
  CASE WHEN e.status <> 'FAILED' THEN m.processed END processed, 'stored' origin
FROM known_execs e LEFT JOIN cuts c ON c.execution_id = e.id LEFT JOIN accepted d ON d.execution_id = e.id AND d.seq = c.cut LEFT JOIN (
  SELECT a.execution_id, max_by('HOSE-' || a.execution_id, a.seq) FILTER (WHERE a.seq % 5 > 0) symbol_key, max_by((a.seq % 1000)::varchar, a.seq) FILTER (WHERE a.seq % 3 = 0) processed
  FROM accepted a JOIN cuts USING (execution_id) WHERE a.seq <= cut GROUP BY a.execution_id) m ON m.execution_id = e.id""", "known_execs", "cuts"))
def status_enriched(spark, sf_dir):
    """Records from the message or its metadata, fields of messages stored with the metadata; only what a message has."""
    seq = F.col("seq")
    messages = fixtures.status_stream(spark, sf_dir).withColumns({
        "records_processed": F.when(seq % 3 == 0, (seq % 1000).cast("int")),
        "symbol_key": F.when(seq % 5 > 0, F.concat(F.lit("HOSE-"), F.col("execution_id"))),
        "meta": F.when(seq % 3 == 1, F.create_map(F.lit("recordsInserted"), (seq % 77).cast("string"))).when(seq % 3 == 2, F.create_map(F.lit("recordsInserted"), F.lit(" "))),
    })
    out = ex.apply_statuses(ex.enriched(messages), _known(spark, sf_dir), id_pattern=None)
    return out.select("id", "status", "records_synced", *[F.col("meta")[k].alias(c) for k, c in (("symbolKey", "symbol_key"), ("executionId", "execution_id"), ("recordsProcessed", "processed"), ("origin", "origin"))])


@query("status_rejects", with_ctes("""
SELECT seq, CASE WHEN status = 'PARTIAL_SUCCESS' THEN 'INVALID_STATUS' ELSE 'UNKNOWN_EXECUTION' END reason
FROM statuses s WHERE status = 'PARTIAL_SUCCESS' OR NOT EXISTS (SELECT 1 FROM known_execs e WHERE e.id = s.execution_id AND e.status = 'PENDING')""", "statuses", "known_execs"))
def status_rejects(spark, sf_dir):
    open_ = _known(spark, sf_dir).where("status = 'PENDING'")
    return ex.rejected_statuses(_statuses(spark, sf_dir), open_, id_pattern=None).select("seq", "reason")


@query("normalize_titles", """
SELECT event_id, 'job ' || event_type || ' run <number> for user <number>' title FROM events""")
def normalize_titles(spark, sf_dir):
    return fixtures.notices(spark, sf_dir).select("event_id", normalized_title(F.col("title")).alias("title"))


define("chain_events", """
SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '|' || event_type dedup_key, ts, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) rn FROM events""")
define("chain", """
SELECT dedup_key, ts, rn FROM chain_events WHERE rn = 1
UNION ALL
SELECT c.dedup_key, n.ts, n.rn FROM chain c, LATERAL (
  SELECT e.ts, e.rn FROM chain_events e WHERE e.dedup_key = c.dedup_key AND e.ts >= c.ts + INTERVAL 6 HOUR ORDER BY e.rn LIMIT 1) n""", "chain_events")


@query("cooldown_dedup", with_ctes("""
SELECT c.dedup_key, c.ts, e.event_id, coalesce(c.rn - lag(c.rn) OVER w - 1, 0)::bigint delivered_suppressed,
  (coalesce(lead(c.rn) OVER w, t.n + 1) - c.rn - 1)::bigint suppressed_after
FROM chain c JOIN chain_events e ON e.dedup_key = c.dedup_key AND e.rn = c.rn JOIN (SELECT dedup_key, count(*) n FROM chain_events GROUP BY 1) t ON t.dedup_key = c.dedup_key
WINDOW w AS (PARTITION BY c.dedup_key ORDER BY c.rn)""", "chain"))
def cooldown_dedup(spark, sf_dir):
    """Six-hour cooldown per severity and kind of event."""
    events = fixtures.load(spark, sf_dir, "events").select(
        F.concat(F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit("|"), F.col("event_type")).alias("dedup_key"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    return cooldown.retained_notices(events, 6 * 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- governance -----------------------------------------------------------------------


_ORDERS_COLUMNS = [
    ("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_totalprice", "DOUBLE"),
    ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "VARCHAR"),
]


@query("dataset_stats", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, '{t}' AS type, count({n}) < count(*) nullable, count(*)::bigint row_count, 6::bigint column_count FROM orders" for n, t in _ORDERS_COLUMNS))
def dataset_stats(spark, sf_dir):
    return gov.dataset_stats(fixtures.load(spark, sf_dir, "orders")).select("name", "type", "nullable", "row_count", big("column_count"))


@query("dataset_time_range", """
SELECT strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') min_timestamp, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') max_timestamp FROM orders""")
def dataset_time_range(spark, sf_dir):
    stats = gov.dataset_stats(fixtures.load(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "date"))
    return stats.select("min_timestamp", "max_timestamp").distinct()


_HASHED = [
    ("nation", [("n_name", "VARCHAR"), ("n_nationkey", "BIGINT"), ("n_regionkey", "BIGINT")]),
    ("region", [("r_name", "VARCHAR"), ("r_regionkey", "BIGINT")]),
    ("supplier", [("s_acctbal", "DOUBLE"), ("s_name", "VARCHAR"), ("s_nationkey", "BIGINT"), ("s_suppkey", "BIGINT")]),
]


def _hash_sql(table: str, columns: list[tuple[str, str]]) -> str:
    parts = " || ',' || ".join(
        f"""'{{"name":"{n}","nullable":' || CASE WHEN count({n}) < count(*) THEN 'true' ELSE 'false' END || ',"type":"{t}"}}'""" for n, t in columns
    )
    return f"""SELECT '{table}' dataset, 'sha256:' || sha256('{{"columns":[' || {parts} || ']}}') schema_hash FROM {table}"""


@query("schema_hash", "\nUNION ALL\n".join(_hash_sql(t, c) for t, c in _HASHED))
def schema_hash(spark, sf_dir):
    return gov.schema_hashes(mf.table_columns(spark, sf_dir, *[t for t, _ in _HASHED]), ["dataset"])


@query("data_version", """
SELECT 'eod' dataset, 'exchange=x' || o_custkey pk, count(*)::bigint object_count,
  'sha256:' || sha256('{"dataset":"eod","inputs":[{"dataVersion":"sha256:' || sha256('symbols') || '","dataset":"symbols","partition":{"exchange":"x' || o_custkey || '"}}],"objects":['
  || string_agg('["eod/' || lpad(o_orderkey::varchar, 12, '0') || '","' || sha256(o_orderstatus) || '"]', ',' ORDER BY lpad(o_orderkey::varchar, 12, '0'))
  || '],"partition":{"exchange":"x' || o_custkey || '"},"schemaHash":"sha256:' || sha256('schema') || '"}') data_version
FROM orders GROUP BY o_custkey""")
def data_version(spark, sf_dir):
    """Customer = partition, order = file."""
    orders = fixtures.load(spark, sf_dir, "orders")
    part = F.create_map(F.lit("exchange"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    objects = orders.select(
        F.lit("eod").alias("dataset"), part.alias("partition"),
        F.concat(F.lit("eod/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"), F.sha2("o_orderstatus", 256).alias("checksum"),
    )
    sha = lambda t: F.concat(F.lit("sha256:"), F.sha2(F.lit(t), 256))
    datasets = orders.select("o_custkey").distinct().select(
        F.lit("eod").alias("dataset"), part.alias("partition"), sha("schema").alias("schema_hash"),
        F.array(F.struct(F.lit("symbols").alias("dataset"), part.alias("partition"), sha("symbols").alias("dataVersion"))).alias("inputs"),
    )
    return gov.data_versions(datasets, objects).select("dataset", "pk", "data_version", big("object_count"))


@query("object_checksums", """
SELECT 'documents/' || doc_id path, 'sha256:' || sha256(coalesce(text, '')) checksum, strlen(coalesce(text, ''))::bigint bytes FROM documents""")
def object_checksums(spark, sf_dir):
    """Each document's text as a stored object."""
    texts = fixtures.load(spark, sf_dir, "documents").select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content")
    )
    return gov.object_checksums(texts)


define("mani", """
SELECT s_suppkey, s_acctbal, n_nationkey, n_regionkey, coalesce(n, 0) n, CASE WHEN s_acctbal < 0 THEN 'FAILED' WHEN s_acctbal < 2000 THEN 'PROCESSING' ELSE 'READY' END eod_status,
  CASE WHEN s_acctbal < 500 THEN 'PROCESSING' ELSE 'READY' END ind_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")


@query("manifest_violations", with_ctes("""
SELECT dataset, s_suppkey, concat_ws(',', CASE WHEN n_nationkey = 3 THEN 'PATH' END, CASE WHEN n_nationkey = 5 THEN 'COLUMN_COUNT' END,
  CASE WHEN status = 'READY' AND s_acctbal > 9500 THEN 'READY_OBJECT_COUNT' END) violations
FROM (SELECT 'eod' dataset, eod_status status, * FROM mani UNION ALL SELECT 'indicators', ind_status, * FROM mani)""", "mani"))
def manifest_violations(spark, sf_dir):
    return gov.manifest_violations(mf.manifests(spark, sf_dir)).select(
        "dataset", "s_suppkey", F.array_join("violations", ",").alias("violations")
    )


@query("manifest_latest_ready", """
SELECT 'orders' dataset, 'customer=c' || o_custkey pk, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F')::bigint run FROM orders GROUP BY o_custkey
HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0""")
def manifest_latest_ready(spark, sf_dir):
    rows = fixtures.load(spark, sf_dir, "orders").select(
        F.lit("orders").alias("dataset"), F.create_map(F.lit("customer"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("partition"),
        F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("FAILED").alias("status"),
        F.col("o_orderkey").alias("run"),
    )
    return gov.latest_ready(rows, "run").select("dataset", "pk", "run")


define("checks", """
SELECT s_suppkey job, condition, condition IN ('READY', 'MIN_ROW_COUNT', 'SUPPORTED_SCHEMA_VERSION') enforced,
  CASE WHEN condition = 'MIN_ROW_COUNT' AND s_acctbal >= 8000 THEN 'ERROR' WHEN s_acctbal > 9000 THEN 'MISSING' WHEN condition = 'EXISTS' THEN 'READY'
    WHEN eod_status <> 'READY' THEN 'NOT_READY' WHEN condition = 'MIN_ROW_COUNT' AND n < 600 THEN 'EMPTY'
    WHEN condition = 'MAX_FRESHNESS_LAG' AND s_acctbal >= 5000 THEN 'STALE' ELSE 'READY' END status
FROM mani, (SELECT unnest(['EXISTS', 'READY', 'MIN_ROW_COUNT', 'MAX_FRESHNESS_LAG', 'SUPPORTED_SCHEMA_VERSION']) condition)""", "mani")


def _checks(spark, sf_dir):
    return gov.dependency_check(mf.dependencies(spark, sf_dir), mf.manifests(spark, sf_dir), _NOW)


@query("dependency_check", with_ctes("SELECT job, condition, enforced, status FROM checks", "checks"))
def dependency_check(spark, sf_dir):
    return _checks(spark, sf_dir).select("job", "condition", "enforced", "status")


@query("job_guard", with_ctes("""
SELECT job, CASE WHEN bool_or(enforced AND status <> 'READY') THEN 'BLOCKED' WHEN bool_or(status <> 'READY') THEN 'READY_WITH_WARNINGS' ELSE 'READY' END verdict
FROM checks GROUP BY job""", "checks"))
def job_guard(spark, sf_dir):
    return gov.job_guard(_checks(spark, sf_dir))


@query("block_reason", with_ctes("""
SELECT job, concat_ws(', ', CASE WHEN m > 0 THEN m || ' missing' END, CASE WHEN nr > 0 THEN nr || ' not ready' END, CASE WHEN s > 0 THEN s || ' stale' END,
  CASE WHEN e > 0 THEN e || ' insufficient rows' END, CASE WHEN x > 0 THEN x || ' errors' END) block_reason FROM (
  SELECT job, count(*) FILTER (WHERE status = 'MISSING') m, count(*) FILTER (WHERE status = 'NOT_READY') nr, count(*) FILTER (WHERE status = 'STALE') s,
    count(*) FILTER (WHERE status = 'EMPTY') e, count(*) FILTER (WHERE status = 'ERROR') x FROM checks WHERE enforced AND status <> 'READY' GROUP BY job)""", "checks"))
def block_reason(spark, sf_dir):
    return gov.block_reasons(_checks(spark, sf_dir))


@query("lineage_staleness", with_ctes("""
SELECT s_suppkey job, CASE WHEN ind_status <> 'READY' THEN 'NOT_READY' WHEN eod_status <> 'READY' THEN 'NOT_READY' WHEN n_regionkey = 1 THEN 'INPUT_VERSION_MISMATCH' ELSE 'READY' END status
FROM mani""", "mani"))
def lineage_staleness(spark, sf_dir):
    return gov.lineage_check(mf.lineage_dependencies(spark, sf_dir), mf.manifests(spark, sf_dir)).select("job", "status")
