import datetime as dt

from pyspark.sql import Window as W, functions as F

from marketlake.operators import cooldown, executions as ex, intraday, signals
from marketlake.sources import companies, datasets as ds, fixtures
from marketlake.streaming import jobs, ticks, upserts

SF_DIR = "/root/testdata/sf0.001"


def staged(spark, df, folder, order, files=4):
    """Write rows as ``files`` files in arrival order and open them as a stream, one per batch."""
    path = f"{folder}/in"
    tagged = df.withColumn("_f", F.ntile(files).over(W.orderBy(order)) - 1).cache()
    for i in range(files):
        tagged.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(path)
    plain = tagged.drop("_f").schema
    return spark.readStream.schema(plain).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, folder, mode):
    name = f"out_{abs(hash(folder))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_status_stream_equals_batch(spark, folder):
    msgs = fixtures.status_stream(spark, SF_DIR).select("seq", "execution_id", "status")
    out = drained(spark, jobs.status_stream_state(staged(spark, msgs, folder, "seq")), folder, "update")
    got = {r.execution_id: r.status for r in sorted(out.collect(), key=lambda r: r.seq)}
    runs = msgs.select(F.col("execution_id").alias("id")).distinct().withColumn("status", F.lit("PENDING"))
    want = {r.id: r.status for r in ex.apply_statuses(msgs, runs, id_pattern=None).where("applied_seq is not null").collect()}
    assert got == want


def test_cooldown_stream_equals_batch(spark, folder):
    notes = fixtures.notices(spark, SF_DIR).select("severity", "ts", "event_id").withColumnRenamed("severity", "dedup_key")
    stream = jobs.cooldown_stream(staged(spark, notes, folder, "ts"), 7200)
    got = {(r.dedup_key, r.event_id, r.delivered_suppressed) for r in drained(spark, stream, folder, "append").collect()}
    want = {(r.dedup_key, r.event_id, r.delivered_suppressed) for r in cooldown.retained_notices(notes, 7200).collect()}
    assert got == want and len(got) > 10


def test_signal_change_stream_equals_batch(spark, folder):
    ev = fixtures.load(spark, SF_DIR, "events").select(
        F.concat(F.lit("X-"), F.col("user_id").cast("string")).alias("symbol_key"), F.lit("S").alias("strategy"), F.lit("1d").alias("timeframe"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("event_id").cast("int")).alias("signal_date"),
        F.when(F.col("value") < 5, "NO_DECISION").when(F.col("value") < 20, "BEARISH").otherwise("BULLISH").alias("signal"),
    )
    stream = jobs.signal_change_stream(staged(spark, ev, folder, "signal_date"))
    got = {(r.symbol_key, r.signal_date, r.previous_signal) for r in drained(spark, stream, folder, "append").collect()}
    batch = signals.deciding_changes(ev).where("signal_changed")
    assert got == {(r.symbol_key, r.signal_date, r.previous_signal) for r in batch.collect()} and got


def test_parent_stream_completes_once(spark, folder):
    rows = [(1, 10, "PENDING", 0), (1, 11, "PENDING", 0), (1, 10, "SUCCESS", 5), (1, 11, "ERROR", 2), (1, 11, "SUCCESS", 9), (2, 20, "RUNNING", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, parent_log_id long, id long, status string, records_synced long")
    out = drained(spark, jobs.parent_stream(staged(spark, df, folder, "n", files=6)), folder, "update").collect()
    done = [r for r in out if r.completed]
    assert len(done) == 1 and (done[0].id, done[0].status, done[0].records_synced, done[0].failed_count) == (1, "FAILED", 7, 1)


def test_commands_are_routed(spark, folder):
    rows = [("signals", '{"symbolKey":"X-A","timeframe":"1d","strategy":"trend_momentum_v1","executionId":"e1"}'),
            ("signals", '{"symbolKey":"X-A","timeframe":"9d","strategy":"trend_momentum_v1","executionId":"e2"}'), ("signals", "oops")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, kind string, value string")
    stream = jobs.decoded_commands(staged(spark, df, folder, "n", files=1))
    q = stream.writeStream.foreachBatch(jobs.route_commands(f"{folder}/out")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.json(f"{folder}/out/commands").first().executionId == "e1"
    error = spark.read.json(f"{folder}/out/errors").first()
    assert (error.executionId, error.status, error.errorMessage) == ("e2", "ERROR", "TIMEFRAME_UNKNOWN")
    assert error.metaJson.timeframe == "9d"
    assert spark.read.json(f"{folder}/out/malformed").first().value == "oops"


def test_symbol_and_sector_upserts(spark, folder):
    stored = companies.stored_symbols(spark, SF_DIR)
    table = ds.VersionedTable(spark, f"{folder}/symbols", stored.select("exchange", "code", "is_active", "meta").schema)
    apply = upserts.symbol_upserts(table)
    base = stored.drop("is_active")
    apply(base, 0)
    part = base.where("exchange = 'HOSE'").limit(1)
    apply(part, 1)
    apply(part, 1)  # the same batch again
    now = table.latest()
    assert now.count() == base.count()
    assert now.where("exchange = 'HOSE' and is_active").count() == 1
    assert now.where("exchange <> 'HOSE' and not is_active").count() == 0

    sectors = companies.sector_table(spark, SF_DIR)
    store = ds.VersionedTable(spark, f"{folder}/sectors", sectors.schema)
    merge = upserts.sector_upserts(store)
    merge(sectors.withColumn("_seq", F.lit(0)), 0)
    merge(sectors.limit(2).withColumns({"name_en": F.lit("New"), "_seq": F.lit(1)}), 1)
    assert store.latest().where("name_en = 'New'").count() == 2 and store.latest().count() == sectors.count()


def test_upserts_after_a_new_checkpoint_keep_rows(spark, folder):
    stored = companies.stored_symbols(spark, SF_DIR)
    base = stored.drop("is_active")
    table = ds.VersionedTable(spark, f"{folder}/symbols", stored.select("exchange", "code", "is_active", "meta").schema)
    sectors = companies.sector_table(spark, SF_DIR)
    store = ds.VersionedTable(spark, f"{folder}/sectors", sectors.schema)
    for batch_id in (0, 1, 2):
        upserts.symbol_upserts(table)(base, batch_id)
        upserts.sector_upserts(store)(sectors, batch_id)
    upserts.symbol_upserts(table)(base.where("exchange = 'HOSE'").limit(1), 0)  # numbers begin anew
    upserts.sector_upserts(store)(sectors.limit(1).withColumn("name_en", F.lit("New")), 0)
    assert table.latest().count() == base.count() and table.latest().where("exchange = 'HOSE' and is_active").count() == 1
    assert store.latest().count() == sectors.count() and store.latest().where("name_en = 'New'").count() == 1


def test_minute_bars_stream_equals_batch(spark, folder):
    t = fixtures.ticks(spark, SF_DIR)
    twice = t.unionByName(t.where("event_id < 20"))
    out = drained(spark, ticks.minute_bar_stream(staged(spark, twice, folder, "market_timestamp"), "1 day"), folder, "append")
    verdicts = {r.verdict: r["count"] for r in intraday.reconcile_bars(out, intraday.trade_bars(t)).groupBy("verdict").count().collect()}
    assert set(verdicts) <= {"MATCH", "MISSING_IN_STREAM"} and verdicts["MATCH"] > 500  # the open end waits for its watermark


def test_tick_intensity_stream(spark, folder):
    t = fixtures.ticks(spark, SF_DIR)
    out = drained(spark, ticks.tick_intensity_stream(staged(spark, t, folder, "market_timestamp"), "1 hour", lateness="1 minute"), folder, "append")
    want = intraday.tick_intensity(t, 3600).select("symbol", "window_start", "trades")
    assert out.select("symbol", "window_start", "trades").exceptAll(want).count() == 0 and out.count() > 100
