import datetime as dt
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketlake import session
from marketlake.operators import governance as gov
from marketlake.schemas import SIGNAL_HISTORY, conform
from marketlake.sources import datasets as ds, fixtures

NOW = dt.datetime(2026, 1, 1)


def test_paths():
    assert ds.dataset_path("/r/", "EOD", {"exchange": "HOSE", "code": " Abc "}) == "/r/eod/exchange=hose/code=abc"
    with pytest.raises(ValueError):
        ds.dataset_path("/r", "eod", {"exchange": " "})


def test_optional_read(spark, folder):
    assert ds.read_optional(spark, f"{folder}/none") is None
    with pytest.raises(Exception):
        ds.read_dataset(spark, f"{folder}/none")
    os.makedirs(f"{folder}/bad")
    with open(f"{folder}/bad/part.parquet", "wb") as fh:
        fh.write(b"not parquet at all")
    with pytest.raises(Exception):
        ds.read_optional(spark, f"{folder}/bad")


def test_partition_overwrite_and_order(spark, folder):
    df = spark.range(10).select(F.when(F.col("id") < 5, "a").otherwise("b").alias("exchange"), "id")
    ds.write_dataset(df, f"{folder}/t", partition_by=["exchange"], order_by=["id"])
    ds.write_dataset(df.where("exchange = 'b'").limit(1), f"{folder}/t", partition_by=["exchange"])
    got = ds.read_dataset(spark, f"{folder}/t")
    assert {r.exchange: r["count"] for r in got.groupBy("exchange").count().collect()} == {"a": 5, "b": 1}
    assert ds.gather(got, "exchange", ["a"]).count() == 5


def test_replace_keeps_old_data_on_failure(spark, folder):
    path = f"{folder}/t"
    ds.replace_dataset(spark.range(3), path)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        ds.replace_dataset(spark.range(9), path, validate=refuse)
    with pytest.raises(Exception):
        ds.replace_dataset(spark.range(9).select(F.raise_error(F.lit("boom")).alias("id")), path)
    assert ds.read_dataset(spark, path).count() == 3
    ds.replace_dataset(spark.range(9), path, validate=lambda df: None)
    assert ds.read_dataset(spark, path).count() == 9
    assert [n for n in os.listdir(folder) if "__" in n] == []


def test_publish_records_ready_last(spark, folder):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), 1.0), (dt.date(2026, 1, 2), None)], "date date, close double")
    part = {"exchange": "hose", "code": "abc"}
    first = ds.publish(df, folder, "eod", part, NOW)
    row = first.first()
    assert (row.status, row.rowCount, row.columnCount, row.objectCount >= 1) == ("READY", 2, 2, True)
    assert row.minTimestamp == "2026-01-01T00:00:00" and row.path == "eod/exchange=hose/code=abc"
    assert gov.manifest_violations(first).first().violations == []
    with pytest.raises(ValueError):
        ds.publish(df.limit(1), folder, "eod", part, NOW, validate=lambda d: (_ for _ in ()).throw(ValueError("bad")))
    assert ds.read_manifests(spark, folder, "eod").count() == 1
    later = ds.publish(df.withColumn("close", F.lit(2.0)), folder, "eod", part, NOW + dt.timedelta(days=1))
    current = gov.latest_ready(later).first()
    assert later.count() == 2 and current.dataVersion != row.dataVersion
    built = ds.publish(df, folder, "indicators", part, NOW, inputs=gov.latest_ready(first))
    deps = spark.createDataFrame(
        [("j", "indicators", part, True, [("eod", part)])], "job string, dataset string, partition map<string,string>, enforced boolean, upstreams array<struct<dataset:string,partition:map<string,string>>>"
    )
    manifests = gov.latest_ready(later).drop("pk").unionByName(built)
    assert gov.lineage_check(deps, manifests).first().status == "INPUT_VERSION_MISMATCH"


def test_versioned_table_is_idempotent(spark, folder):
    table = ds.VersionedTable(spark, f"{folder}/v", SIGNAL_HISTORY)
    assert table.latest().count() == 0
    one = spark.createDataFrame([("X-A",)], "symbol_key string")
    table.write(conform(one, SIGNAL_HISTORY), 0)
    for _ in range(2):  # a retried batch
        before = table.latest(below=1)
        table.write(before.unionByName(conform(one, SIGNAL_HISTORY)), 1)
    assert table.latest().count() == 2


def test_events_round_trip(spark, folder):
    ds.append_events(spark.createDataFrame([("HOSE", '{"a":1}')], "key string, value string"), f"{folder}/e")
    assert spark.read.json(f"{folder}/e").first().key == "HOSE"


def test_publications_are_numbered_and_never_absent(spark, folder):
    part, other = {"exchange": "hose", "code": "007"}, {"exchange": "hose", "code": "8"}
    ds.publish(spark.range(3), folder, "eod", part, NOW)
    seen = []

    def look_then_refuse(df):
        seen.append(ds.read_published(spark, folder, "eod", [part]).count())
        raise ValueError("no")

    with pytest.raises(ValueError):
        ds.publish(spark.range(5), folder, "eod", part, NOW, validate=look_then_refuse)
    assert seen == [3] and not os.path.exists(f"{folder}/eod/exchange=hose/code=007/publication=2")
    ds.publish(spark.range(7), folder, "eod", part, NOW, validate=lambda df: seen.append(ds.read_published(spark, folder, "eod", [part]).count()))
    assert seen == [3, 3]
    # the clock goes back: the number decides
    ds.publish(spark.range(9), folder, "eod", part, NOW - dt.timedelta(days=1))
    ds.publish(spark.range(2).selectExpr("id", "'data' as code"), folder, "eod", other, NOW)
    got = ds.read_published(spark, folder, "eod")
    assert sorted((r.code, r.publication, r["count"]) for r in got.groupBy("code", "publication").count().collect()) == [("007", 4, 9), ("8", 5, 2)]
    assert ds.read_published(spark, folder, "eod", [other]).select("code").distinct().first().code == "8"
    with pytest.raises(ValueError):
        ds.read_published(spark, folder, "eod", [part, {"exchange": "hose", "code": "9"}])
    # publication 3 was replaced by one whose clock is earlier, publication 1 at NOW
    assert ds.expire_publications(spark, folder, "eod", NOW + dt.timedelta(seconds=1)) == 2
    assert ds.read_published(spark, folder, "eod").count() == 11
    assert ds.expire_publications(spark, folder, "eod", NOW - dt.timedelta(days=2)) == 0


def test_publication_numbers_are_taken_once(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(lambda _: ds._claim(spark, folder, "eod"), range(12)))
    assert len(set(taken)) == 12 and ds._claim(spark, folder, "eod") > max(taken)
    assert [ds._claim(spark, folder, "other") for _ in range(3)] == [1, 2, 3]


def test_history_files_are_in_canonical_order(spark, folder):
    from marketlake.operators import history

    rows = spark.range(500).selectExpr(
        "if(id % 2 = 0, 'S1', 'S2') strategy", "'1d' timeframe", "if(id % 3 = 0, 'A', 'B') exchange", "concat('K', id % 7) symbol_key",
        "date_add(date'2024-01-01', cast((id * 37) % 100 as int)) signal_date",
    )
    ds.write_dataset(rows, f"{folder}/h", partition_by=["exchange"], order_by=history.CANONICAL_ORDER)
    by_file = spark.read.parquet(f"{folder}/h").select(F.input_file_name().alias("file"), *history.CANONICAL_ORDER).collect()
    files = {}
    for r in by_file:
        files.setdefault(r.file, []).append(tuple(r)[1:])
    assert len(files) >= 2 and all(rows == sorted(rows) for rows in files.values())


def test_shuffles_grow_with_the_table(spark, monkeypatch):
    """Twelve or so partitions for a table of as many parts, and a smaller table does not lower them."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(session, "TABLE_BYTES", 10_000)
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        plan = fixtures.eod(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        parts = -(-Path("/root/testdata/sf0.001/lineitem.parquet").stat().st_size // 10_000)
        assert parts > 4 and f", {parts})" in re.search(r"hashpartitioning\(.*", plan).group()
        fixtures.load(spark, "/root/testdata/sf0.001", "nation")
        assert int(spark.conf.get(key)) == parts
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_scans_are_split_by_size(spark, monkeypatch):
    """A task reads a bounded part of a table, also of a large one; a session's own bound stays."""
    key = "spark.sql.files.maxPartitionBytes"
    size = Path("/root/testdata/sf0.001/lineitem.parquet").stat().st_size
    monkeypatch.setattr(session, "SPLIT_BYTES", "20000", raising=False)
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        assert fixtures.load(spark, "/root/testdata/sf0.001", "lineitem").rdd.getNumPartitions() == -(-size // 20_000) > 1
        spark.conf.set(key, "50000")
        assert fixtures.load(spark, "/root/testdata/sf0.001", "lineitem").rdd.getNumPartitions() == -(-size // 50_000)
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
