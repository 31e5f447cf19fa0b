from marketlake.llm import exact_dedup
from tests.llm.conftest import LONG


def test_odd_rows(odd):
    got = {(r["doc_id"], r["n"]): r for r in exact_dedup.exact_copies(odd).groupBy("doc_id", "keep_id", "group_size", "kept").count().withColumnRenamed("count", "n").collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert got[5, 2]["kept"] and got[5, 2]["group_size"] == 4  # 4, twice 5, 9: longest first, then the smallest id
    assert by_id[4]["keep_id"] == by_id[9]["keep_id"] == 5 and not by_id[4]["kept"]
    assert by_id[3]["kept"] and {by_id[i]["keep_id"] for i in (1, 2, 3)} == {3}
    assert by_id[None]["kept"] and by_id[6]["kept"] and by_id[8]["kept"]


def test_collisions_are_chained(docs):
    plain = exact_dedup.exact_copies(docs).drop("bucket", "chain").toPandas().sort_values("doc_id").reset_index(drop=True)
    few = exact_dedup.exact_copies(docs, key_of=lambda text: len(text) % 3)
    assert few.agg({"chain": "max"}).first()[0] > 10
    assert few.drop("bucket", "chain").toPandas().sort_values("doc_id").reset_index(drop=True).equals(plain)


def test_directory_splits_full_buckets_only(spark):
    keys = spark.range(1000).selectExpr("case when id < 900 then id else shiftleft(id, 54) end as key").distinct()
    slots, depth = exact_dedup.directory(keys, capacity=64)
    rows = {(r["bucket"], r["bits"]) for r in slots.collect()}
    assert depth == exact_dedup.MOST_BITS and len({b for _, b in rows}) > 1
    slots, depth = exact_dedup.directory(keys.limit(0))
    assert slots.count() == 0


def test_dropping_keeps_columns(odd, empty):
    got = exact_dedup.drop_exact_copies(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 3, 5, 6, 7, 8, 10, 11]
    assert next(r["text"] for r in rows if r["doc_id"] == 8) == LONG
    assert exact_dedup.exact_copies(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_group_comes_from_the_chain(spark):
    rows = [(i, " " * (i % 3) + "ab" if i % 2 else "cd\n" * (1 + i % 5)) for i in range(5000)] + [(None, "a b   "), (7, None), (7, "\t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    groups = {}
    for row_id, text in rows:
        row_id = None if row_id is None else str(row_id)
        groups.setdefault("".join((text or "").split()), []).append((-len(text or ""), row_id is None, row_id))
    for key_of in (exact_dedup._key64, lambda text: 1):
        got = exact_dedup.exact_copies(docs, key_of=key_of).groupBy("text_sha256", "keep_id", "group_size", "chain").count().collect()
        assert sorted((r["keep_id"] or "", r["group_size"]) for r in got) == sorted((min(g)[2] or "", len(g)) for g in groups.values())
        assert all(r["count"] == r["group_size"] for r in got)
