import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from marketlake.functions.text import canonical_code, join_symbol_key, normalized_title, snake_case, split_symbol_key, taxonomy_level
from marketlake.operators import commands, cooldown, executions as ex, governance as gov, normalize, symbols as sym, taxonomy as tax
from marketlake.session import cut_lineage

NOW = dt.datetime(2026, 1, 1)
U = "00000000-0000-4000-8000-00000000000{}"


@pytest.mark.parametrize(
    "name, want",
    [("NMValue", "nm_value"), ("TradingDate", "trading_date"), ("foreign-buy-value", "foreign_buy_value"), ("totalVolume", "total_volume"),
     ("  Odd__Name ", "odd_name"), ("icbLv1Code", "icb_lv1_code"), ("HTTPServer2Go", "http_server2_go"), ("already_fine", "already_fine")],
)
def test_snake_case(name, want):
    assert snake_case(name) == want


def test_colliding_columns(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "totalVolume int, total_volume int")
    assert [r.total_volume for r in normalize.normalize_columns(df).collect()] == [1, 2, 3]
    clash = spark.createDataFrame([(100, 200)], "totalVolume int, total_volume int")
    with pytest.raises(Exception, match="different values"):
        normalize.normalize_columns(clash).collect()


def test_text_rules(spark):
    row = spark.range(1).select(
        canonical_code(F.lit(" Oil & Gas-North ")).alias("code"), join_symbol_key(F.lit("hose"), F.lit("abc")).alias("key"),
        *[c.alias(f"s{i}") for i, c in enumerate(split_symbol_key(F.lit("X-A-B")))],
        *[c.alias(f"b{i}") for i, c in enumerate(split_symbol_key(F.lit("X- ")))],
        taxonomy_level(F.lit(7)).alias("level"),
        normalized_title(F.lit("  Run 3fa85f64-5717-4562-b3fc-2c963f66afa6 at 2026-01-02T10:11:12Z  took 15 s")).alias("title"),
    ).first()
    assert (row.code, row.key, row.s0, row.s1, row.b0, row.level) == ("OIL_AND_GAS_NORTH", "HOSE-ABC", "X", "A-B", None, 1)
    assert row.title == "run <uuid> at <timestamp> took <number> s"


def _chain(events, cooldown_us):
    """Brute force over one key: (t, id) pairs in order -> retained (t, id, delivered, after)."""
    out, anchor = [], None
    for t, i in sorted(events):
        if anchor is None or t >= anchor[0] + cooldown_us:
            out.append([t, i, anchor[2] if anchor else 0, 0])
            anchor = [t, i, 0]
        else:
            anchor[2] += 1
            out[-1][3] += 1
    return [tuple(x) for x in out]


def _compare_chain(spark, events, seconds):
    df = spark.createDataFrame(events, "dedup_key string, t long, event_id long").withColumn("ts", F.timestamp_micros("t"))
    got = {}
    for r in cooldown.retained_notices(df, seconds).withColumn("t", F.unix_micros("ts")).collect():
        got.setdefault(r.dedup_key, []).append((r.t, r.event_id, r.delivered_suppressed, r.suppressed_after))
    keys = {k for k, _, _ in events}
    assert {k: sorted(v) for k, v in got.items()} == {k: _chain([(t, i) for kk, t, i in events if kk == k], int(seconds * 1e6)) for k in keys}


def test_cooldown_against_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(cooldown, "BLOCK_COOLDOWNS", 3)
    rng = random.Random(5)
    events = [("hot", rng.randrange(0, 900_000_000), i) for i in range(3000)]
    events += [("hot", -rng.randrange(0, 50_000_000), 5000 + i) for i in range(100)]
    events += [(f"k{i % 40}", rng.randrange(0, 900_000_000), 10_000 + i) for i in range(800)]
    events += [("same", 1_000_000, 20_000 + i) for i in range(5)] + [("steady", 10_000_000 * i, 30_000 + i) for i in range(60)]
    _compare_chain(spark, events, 10)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120), st.sampled_from([1, 7, 30]))
def test_cooldown_property(spark, seconds, gap):
    _compare_chain(spark, [("k", s * 1_000_000, i) for i, s in enumerate(seconds)], gap)


def test_a_burst_within_one_cooldown(spark):
    """Many instants in one cooldown are one target, and the plan has neither Python nor many exchanges."""
    burst = spark.range(200_000).select(F.lit("k").alias("dedup_key"), F.timestamp_micros(F.col("id") * 40).alias("ts"), F.col("id").alias("event_id"))
    late = spark.range(3).select(F.lit("k").alias("dedup_key"), F.timestamp_micros(F.col("id") * 9_000_000 + 12_000_000).alias("ts"), (F.col("id") + 200_000).alias("event_id"))
    out = cooldown.retained_notices(burst.union(late), 10)
    got = sorted((r.event_id, r.delivered_suppressed, r.suppressed_after) for r in out.collect())
    assert got == [(0, 0, 199_999), (200_000, 199_999, 1), (200_002, 1, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange ") <= 10


def test_anchors_carry_a_chain_over_batches(spark):
    rng = random.Random(8)
    events = sorted((f"k{rng.randrange(3)}", rng.randrange(0, 300) * 1_000_000, i) for i in range(400))
    events.sort(key=lambda e: (e[1], e[2]))
    anchors = spark.createDataFrame([], "dedup_key string, anchor timestamp, pending long")
    got = []
    for start in range(0, 400, 80):
        part = spark.createDataFrame(events[start : start + 80], "dedup_key string, t long, event_id long").withColumn("ts", F.timestamp_micros("t"))
        retained, anchors = cooldown.after_anchors(part, anchors, 20)
        anchors = cut_lineage(anchors)
        got += [(r.dedup_key, r.event_id, r.delivered_suppressed) for r in retained.collect()]
    want = {k: _chain([(t, i) for kk, t, i in events if kk == k], 20_000_000) for k in ("k0", "k1", "k2")}
    # an instant that two batches share keeps the id of the first
    assert sorted(got) == sorted((k, i, d) for k, rows in want.items() for _, i, d, _ in rows)
    assert {r.dedup_key: r.pending for r in anchors.collect()} == {k: rows[-1][3] for k, rows in want.items()}


def messages(spark, rows):
    return spark.createDataFrame(rows, "seq long, execution_id string, status string, parent_execution_id string, meta map<string,string>")


def test_enriched_statuses(spark):
    rows = [(1, "a", None, None, {"recordsProcessed": "7", "recordsInserted": "3", "symbolKey": "old"}), (2, "b", 5, "HOSE-X", {"symbolKey": "old", "x": "1"}),
            (3, "c", None, None, {"recordsProcessed": " ", "recordsInserted": "3"}), (4, "d", None, None, {"recordsProcessed": "odd", "recordsInserted": "1.5"}), (5, "e", None, None, None)]
    got = {r.seq: (r.records_synced, r.meta) for r in ex.enriched(spark.createDataFrame(rows, "seq long, execution_id string, records_processed int, symbol_key string, meta map<string,string>")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 7, 2: 5, 3: 3, 4: 0, 5: 0}
    assert got[1][1] == {"recordsProcessed": "7", "recordsInserted": "3", "symbolKey": "old", "executionId": "a"}
    assert got[2][1] == {"symbolKey": "HOSE-X", "x": "1", "executionId": "b", "recordsProcessed": "5"} and got[5][1] == {"executionId": "e"}


def test_first_terminal_status_wins(spark):
    runs = spark.createDataFrame(
        [(U.format(1), "PENDING", {"a": "0"}), (U.format(2), "SUCCESS", {}), (U.format(3), "PENDING", {})], "id string, status string, meta map<string,string>"
    )
    msgs = messages(spark, [
        (1, U.format(1), "running", None, {"a": "1", "b": "1"}), (2, U.format(1), "ERROR", None, {"b": "2"}), (3, U.format(1), "SUCCESS", None, {"b": "3"}),
        (4, U.format(2), "FAILED", None, {}), (5, "nope", "SUCCESS", None, {}), (6, U.format(1), "PARTIAL_SUCCESS", None, {}),
        (7, U.format(9), "SUCCESS", None, {}), (8, U.format(3), "SUCCESS", None, {"recordsProcessed": "x"}), (9, U.format(3), "SUCCESS", "bad", {}),
    ])
    rows = {r.id: r for r in ex.apply_statuses(msgs, runs).collect()}
    assert rows[U.format(1)].status == "FAILED" and rows[U.format(1)].meta == {"a": "1", "b": "2"}
    assert rows[U.format(2)].status == "SUCCESS" and rows[U.format(3)].status == "PENDING"
    rejected = {r.seq: r.reason for r in ex.rejected_statuses(msgs, runs).collect()}
    assert rejected == {5: "INVALID_EXECUTION_ID", 6: "INVALID_STATUS", 7: "UNKNOWN_EXECUTION", 8: "INVALID_NUMERIC_METADATA", 9: "INVALID_PARENT_EXECUTION_ID"}


def test_rollup(spark):
    t = dt.datetime(2025, 1, 1)
    kids = spark.createDataFrame(
        [(1, "SUCCESS", t, t, 5), (1, "FAILED", t, t + dt.timedelta(hours=1), 7), (2, "SUCCESS", t, t, 5), (2, "RUNNING", t, None, 1), (4, "SUCCESS", t, t, 9)],
        "parent_log_id long, status string, started_at timestamp, finished_at timestamp, records_synced long",
    )
    parents = spark.createDataFrame([(1, "PENDING"), (2, "PENDING"), (3, "PENDING"), (4, "FAILED")], "id long, status string")
    rows = {r.id: r for r in ex.rollup(parents, kids, NOW).collect()}
    assert (rows[1].status, rows[1].error, rows[1].records_synced, rows[1].finished_at.hour) == ("FAILED", "1/2 tasks failed", 12, 1)
    assert (rows[2].status, rows[2].finished_at, rows[2].error) == ("RUNNING", None, None)
    assert (rows[3].status, rows[3].records_synced, rows[3].finished_at) == ("SUCCESS", 0, NOW)
    assert rows[4].status == "FAILED" and rows[4].records_synced is None


def test_digest_lists_twenty(spark):
    meta = F.create_map(F.lit("signalChanged"), F.lit("True"), F.lit("symbolKey"), F.col("seq").cast("string"), F.lit("timeframe"), F.when(F.col("seq") > 3, "1d").otherwise(" "))
    kids = spark.range(23).select(F.lit(1).alias("parent_log_id"), F.lit("SUCCESS").alias("status"), F.col("id").alias("seq")).withColumn("meta", meta)
    row = ex.signal_digest(spark.createDataFrame([(1, "SUCCESS")], "id int, status string"), kids).first()
    lines = row.message.split("\n")
    assert len(lines) == 22 and lines[-1] == "...3 more changes omitted" and lines[1].startswith("- 0: BASELINE -> null @ n/a")
    assert (row.strategy, row.timeframe, row.changed_count) == ("UNKNOWN", "1d", 23)


def test_command_rules(spark):
    rows = [
        ("indicators", '{"symbolKey":"X-A","timeframe":"1d","indicatorSource":"ad_close","indicators":["ma20"]}'),
        ("indicators", '{"symbolKey":"XA","timeframe":"1h","indicators":[]}'),
        ("sector_transition", '{"timeframe":"1d","evaluationDate":"2026-01-01","sectorCodes":["a"],"focusSectorCodes":["b"],"sectorLevel":0,"predictionHorizons":[0]}'),
        ("rotation_backtest", '{"timeframe":"1d","strategy":" sector_wave_v1 ","sectorCodes":[" "],"sectorLevel":1}'),
        ("what", '{"timeframe":"1d"}'), ("signals", "null"), ("signals", None), ("signals", "{"),
    ]
    out = commands.validated(commands.decode_json(spark.createDataFrame(rows, "kind string, value string"))).collect()
    assert [r.malformed for r in out] == [False] * 5 + [True] * 3
    assert out[0].violations == []
    assert out[1].violations == ["TIMEFRAME_NOT_ENABLED", "SYMBOL_KEY_INVALID", "INDICATOR_SOURCE_REQUIRED", "INDICATORS_UNSUPPORTED"]
    assert out[2].violations == ["SECTOR_LEVEL_INVALID", "FOCUS_OUTSIDE_SECTOR_CODES", "HORIZONS_INVALID"]
    assert out[3].violations == ["SECTOR_CODES_REQUIRED"]
    assert out[4].violations == ["KIND_UNKNOWN"]


def test_unknown_status_is_an_error(spark):
    df = spark.createDataFrame([("X-A", "e", "DONE", 1, 2, NOW, NOW)], "symbolKey string, executionId string, status string, records_inserted int, total_records int, startedAt timestamp, finishedAt timestamp")
    df = df.withColumns({"new_offset": F.lit(None), "error_message": F.lit(None)})
    with pytest.raises(Exception, match="unknown job status"):
        commands.status_records(df).collect()


SHA = "sha256:" + "a" * 64


def manifest(**kw):
    base = dict(
        version=1, dataset="eod", partition={"exchange": "hose"}, status="READY", path="eod/hose", dataVersion=SHA, objectCount=1, totalBytes=1, rowCount=1,
        columnCount=1, columns=[("date", "TIMESTAMP", False)], schemaVersion=1, schemaHash=SHA, generatedAt="2026-01-01T00:00:00Z",
        minTimestamp=None, maxTimestamp=None, inputs=[], sourceExecutionId=None,
    )
    return tuple({**base, **kw}.values())


@pytest.mark.parametrize(
    "kw, code",
    [({"version": 2}, "UNSUPPORTED_VERSION"), ({"schemaVersion": 2}, "UNSUPPORTED_SCHEMA_VERSION"), ({"dataset": "EOD"}, "DATASET_NAME"), ({"partition": {"a": "../b"}}, "PARTITION"),
     ({"path": "/abs"}, "PATH"), ({"path": "a/../b"}, "PATH"), ({"status": "DONE"}, "STATUS"), ({"rowCount": -1}, "NEGATIVE_COUNT"), ({"columnCount": 2}, "COLUMN_COUNT"),
     ({"inputs": None}, "INPUTS_REQUIRED"), ({"inputs": [("eod", {}, "x")]}, "INPUT"), ({"dataVersion": "x"}, "READY_DATA_VERSION"), ({"objectCount": 0}, "READY_OBJECT_COUNT")],
)
def test_manifest_rules(spark, kw, code):
    from marketlake.schemas import MANIFEST

    df = spark.createDataFrame([manifest(**kw)], MANIFEST)
    assert gov.manifest_violations(df).first().violations == [code]


def test_version_depends_on_content_only(spark):
    def version(files, inputs, schema="s", part=None):
        part = part or {"b": "2", "a": "1"}
        objects = spark.createDataFrame([("eod", part, p, c) for p, c in files], "dataset string, partition map<string,string>, path string, checksum string")
        data = spark.createDataFrame([("eod", part, schema, inputs)], "dataset string, partition map<string,string>, schema_hash string, inputs array<struct<dataset:string,partition:map<string,string>,dataVersion:string>>")
        return gov.data_versions(data, objects).first().data_version

    one, two = ("x", {"k": "v"}, SHA), ("y", {}, SHA)
    base = version([("p1", "c1"), ("p2", "c2")], [one, two])
    assert base == version([("p2", "c2"), ("p1", "c1")], [two, one], part={"a": "1", "b": "2"})
    assert base != version([("p1", "c1"), ("p2", "cX")], [one, two])
    assert base != version([("p1", "c1"), ("p2", "c2")], [one])
    assert base != version([("p1", "c1"), ("p2", "c2")], [one, two], schema="t")


def test_snapshot_state(spark):
    current = spark.createDataFrame([("X", "A", True, {"k": "1"}), ("X", "B", False, {}), ("Y", "C", True, {})], "exchange string, code string, is_active boolean, meta map<string,string>")
    incoming = spark.createDataFrame([("X", "B", {"k": "2"}), ("X", "D", {})], "exchange string, code string, meta map<string,string>")
    rows = {r.code: (r.is_active, r.meta) for r in sym.apply_snapshot(current, incoming).collect()}
    assert rows == {"A": (False, {"k": "1"}), "B": (True, {"k": "2"}), "C": (True, {}), "D": (True, {})}
    untouched = sym.apply_snapshot(current, incoming.where("1 = 0")).where("code = 'A'").first()
    assert untouched.is_active


def test_sector_merge_and_seeds(spark):
    rows = [(0, "A", None, "Vi one"), (1, "B", "S1", None), (2, "C", "S2", "Vi two")]
    recs = spark.createDataFrame(rows, "_seq int, symbol_code string, source_code string, name_vi string").withColumns(
        {"sector_code": F.lit("X"), "taxonomy": F.lit("ICB"), "taxonomy_level": F.lit(2), "name_en": F.lit(None).cast("string"), "symbol_exchange": F.lit("H")}
    )
    row = tax.merged_sector_records(recs).first()
    assert (row.source_code, row.name_vi, row.name_en, row.meta["sourceSymbolCode"]) == ("S1", "Vi one", None, "C")
    seeds = tax.seed_sectors(spark)
    assert seeds.count() == 19 and tax.seed_sectors(spark, seeds.limit(5)).count() == 14


def test_coverage_thresholds(spark):
    def frame(matched, total):
        return spark.range(total).select(F.when(F.col("id") < matched, "x").alias("sourceSectorCode"))

    assert sym.coverage_problem(frame(99, 100)) is None
    assert "97.00%" in sym.coverage_problem(frame(97, 100))
    with pytest.raises(ValueError, match="89.00%"):
        sym.coverage_problem(frame(89, 100))
    assert sym.coverage_problem(frame(0, 0)) is None


def test_portfolio_decimals(spark):
    from marketlake.operators import portfolio

    rows = [("P", "A", "BUY", 10, 2.5, 0.1, 0.0, "2026-01-01"), ("P", "A", "SELL", 4, 3.0, 0.1, 0.1, "2026-01-02"), ("P", "A", "STOCK_DIVIDEND", 1, 0.0, 0.0, 0.0, "2026-01-02")]
    df = spark.createDataFrame(rows, "portfolio_id string, symbol string, type string, quantity long, price double, fee double, tax double, txn_date string")
    out = portfolio.positions(df).orderBy("txn_date").collect()
    assert [r.position for r in out] == [10, 7]
    assert [float(r.cash_flow) for r in out] == [-25.1, -13.3]


def test_industry_paths_of_any_depth_and_cycles(spark):
    from marketlake.operators.reference_data import industry_paths

    chain = spark.createDataFrame([(c, p) for c, p in zip("abcdef", [None, *"abcde"])], "icb_code string, parent_code string")
    last = industry_paths(chain).where("icb_code = 'f'").first()
    assert (last["depth"], last["root_code"], last["path"]) == (6, "a", list("abcdef"))
    with pytest.raises(ValueError, match="own ancestors"):
        industry_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "icb_code string, parent_code string"))


def test_numeric_metadata_takes_whole_numbers_only(spark):
    from pyspark.sql import functions as F

    from marketlake.operators.executions import rejected_statuses

    rows = [(f"E{i}", "SUCCESS", v) for i, v in enumerate(["7", "-3", "3.5", "1e5", "99999999999", " "])]
    messages = spark.createDataFrame(rows, "execution_id string, status string, v string").select("execution_id", "status", F.create_map(F.lit("recordsProcessed"), "v").alias("meta"), F.lit(1).cast("long").alias("seq"))
    known = spark.createDataFrame([(f"E{i}",) for i in range(6)], "id string").select("id", F.col("id").alias("execution_id"))
    bad = rejected_statuses(messages, known, id_pattern=None)
    assert sorted(r["execution_id"] for r in bad.collect()) == ["E2", "E3", "E4"]


def test_checksums_of_objects(spark):
    import hashlib

    from marketlake.operators.governance import object_checksums

    got = object_checksums(spark.createDataFrame([("p", "é"), ("q", "")], "path string, content string")).collect()
    assert [(r["bytes"], r["checksum"].endswith(hashlib.sha256(t.encode()).hexdigest())) for r, t in zip(got, ("é", ""))] == [(2, True), (0, True)]
