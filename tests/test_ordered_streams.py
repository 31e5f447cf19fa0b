"""Streams driven by event time, and streams kept as tables of batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marketlake import session
from marketlake.plans.catalog import QUERIES
from marketlake.streaming import ledger, ordered, runs

CHANGES = "symbol_key string, strategy string, timeframe string, signal_date date, signal string"


def _day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def _files(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return runs.folder_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)


def test_changes_in_date_order_whatever_order_rows_come_in(spark, folder):
    rng = random.Random(2)
    rows = [(f"k{k}", "S", "1d", _day(n), rng.choice(["BULLISH", "BEARISH", "NEUTRAL", "NO_DECISION"])) for k in range(4) for n in range(60)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    parts = [shuffled[k::5] for k in range(5)]
    parts[3] += parts[0][:7]  # repeats change nothing
    parts.append([("-", "S", "1d", _day(5000), "NO_DECISION")])
    parts.append([("k0", "S", "1d", _day(3), "BULLISH"), ("k1", "S", "1d", _day(59), "BEARISH")])  # after the watermark: dropped
    parts.append([("-", "S", "1d", _day(6000), "NO_DECISION")])
    out = runs.drained(ordered.ordered_signal_changes(_files(spark, folder, parts, CHANGES), "400 days"))
    got = {(r.symbol_key, r.signal_date, r.previous_signal, r.new_signal) for r in out.collect()}
    want = set()
    for k in range(4):
        told = sorted((d, s) for key, _, _, d, s in rows if key == f"k{k}" and s != "NO_DECISION")
        want |= {(f"k{k}", b[0], a[1], b[1]) for a, b in zip(told, told[1:]) if a[1] != b[1]}
    assert got == want and len(got) == out.count()


def test_closed_executions_leave_the_state(spark, folder):
    t = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    parts = [
        [(1, "a", "RUNNING", t(0)), (2, "b", "RUNNING", t(0)), (3, "a", "SUCCESS", t(1))],
        [(4, "a", "FAILED", t(2)), (5, "b", "PENDING", t(3))],  # within the bound: ignored
        [(6, "c", "error", t(40))],
        [(7, "c", "SUCCESS", t(41))],
    ]
    stream = ordered.status_with_expiry(_files(spark, folder, parts, "seq long, execution_id string, status string, ts timestamp"), "1 hour", 6 * 3600)
    progress = f"{folder}/progress"
    runs.run_batches(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), progress, "update")
    rows = sorted((r.seq, r.execution_id, r.status) for r in spark.read.parquet(f"{folder}/out").collect())
    # of one batch the closing message counts
    assert rows == [(2, "b", "RUNNING"), (3, "a", "SUCCESS"), (5, "b", "PENDING"), (6, "c", "FAILED")]
    held = spark.read.format("statestore").option("stateVarName", "last").load(progress)
    assert {r[0] for r in held.select("key.execution_id").collect()} == {"b", "c"}


def test_parents_complete_once_over_restarts_and_retries(spark, folder):
    schema = "parent_log_id long, id long, status string, records_synced long, seq long"
    parts = [
        [(1, 10, "PENDING", 0, 1), (1, 11, "PENDING", 0, 2), (2, 20, "running", 1, 3)],
        [(1, 10, "SUCCESS", 5, 4), (1, 11, "ERROR", 2, 5)],
        [(1, 11, "SUCCESS", 9, 6), (3, 30, "SUCCESS", 4, 7)],
        [(1, 12, "PENDING", 0, 8), (2, 20, "SUCCESS", 6, 9)],
    ]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    out = runs.fed_in_parts(frames, ledger.parent_batches)
    for number in (1, 3):
        ledger.parent_batches(out)(frames[number], number)  # the same batch again
    done = {(r.id, r.status, r.child_count, r.failed_count, r.records_synced, r.batch) for r in ledger.written(spark, out, "completions", ledger._PARENT).collect()}
    assert done == {(1, "FAILED", 2, 1, 7, 1), (3, "SUCCESS", 1, 0, 4, 2), (2, "SUCCESS", 1, 0, 6, 3)}
    last = {r.id: r.status for r in ledger.written(spark, out, "states", ledger._PARENT).where("batch = 3").collect()}
    assert last == {1: "RUNNING", 2: "SUCCESS"}  # a child announced late reopens the state, not the completion


def test_cooldown_batches_carry_anchors(spark, folder):
    rows = [("a", 0, 1), ("a", 5, 2), ("b", 6, 3), ("a", 12, 4), ("a", 14, 5), ("b", 15, 6), ("a", 30, 7)]
    frames = [spark.createDataFrame(rows[k : k + 3], "dedup_key string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")) for k in (0, 3, 6)]
    out = runs.fed_in_parts(frames, lambda root: ledger.cooldown_batches(root, 10))
    ledger.cooldown_batches(out, 10)(frames[2], 2)
    got = {(r.dedup_key, r.event_id, r.delivered_suppressed) for r in ledger.written(spark, out, "retained", "dedup_key string, event_id long, delivered_suppressed long").collect()}
    assert got == {("a", 1, 0), ("b", 3, 0), ("a", 4, 1), ("a", 7, 1)}


def _told_changes(rows):
    want = set()
    for key in {r[0] for r in rows}:
        told = sorted((d, s) for k, _, _, d, s in rows if k == key and s != "NO_DECISION")
        want |= {(key, b[0], a[1], b[1]) for a, b in zip(told, told[1:]) if a[1] != b[1]}
    return want


def test_batches_of_signals_in_date_order_whatever_order_rows_come_in(spark, folder):
    rng = random.Random(3)
    rows = [(f"k{k}", "S", "1d", _day(n), rng.choice(["BULLISH", "BEARISH", "NEUTRAL", "NO_DECISION"])) for k in range(5) for n in range(90)]
    rows = [r for r in rows if not (r[0] == "k4" and r[3] > _day(30))]  # a series that ends keeps its last signal
    near = sorted(rows, key=lambda r: (r[3].toordinal() + rng.randrange(8), r))  # up to seven days out of order
    parts = [near[k * 40 : k * 40 + 40] for k in range(10)]
    parts[6] += [(k, a, b, _day(2), "BULLISH") for k, a, b, _, _ in parts[6][:3]]  # passed: dropped
    repeated = next(r for r in parts[9] if r[4] == "BULLISH")
    parts[9].append((*repeated[:4], "BEARISH"))  # of rows that repeat a day the last by name counts
    parts.append([("k4", "S", "1d", _day(100), "BULLISH"), ("-", "S", "1d", _day(200), "NO_DECISION")])
    rows.append(parts[10][0])
    frames = [spark.createDataFrame(p, CHANGES) for p in parts]
    out = runs.fed_in_parts(frames, lambda root: ledger.signal_change_batches(root, 8))
    early = ledger.signal_changes(spark, out).where("batch < 9").count()
    ledger.signal_change_batches(out, 8)(frames[10], 10)  # the same batch again
    got = [(r.symbol_key, r.signal_date, r.previous_signal, r.new_signal) for r in ledger.signal_changes(spark, out).collect()]
    assert early > 0 and sorted(got) == sorted(_told_changes(rows))
    kept = {r.batch for r in ledger.written(spark, out, "held", ledger._HELD).select("batch").distinct().collect()}
    assert kept and min(kept) >= 7  # what all of its days passed is gone


def test_a_part_of_the_change_stream_is_not_one_file(spark, monkeypatch):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, asked = spark.conf.get(initial, None), []
    monkeypatch.setattr(session, "TABLE_BYTES", 1 << 12)
    folder_stream = runs.folder_stream
    monkeypatch.setattr(runs, "folder_stream", lambda spark, path, schema, files: asked.append((path, files)) or folder_stream(spark, path, schema, files))
    try:
        assert QUERIES["signal_change_stream"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset(initial) if before is None else spark.conf.set(initial, before)
    (path, files), = asked
    assert files > 1 and -(-(len(spark.read.parquet(path).inputFiles()) - 1) // 8) == files  # eight batches, then the closing row
