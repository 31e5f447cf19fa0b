import itertools
import random
import re

import numpy as np
import xxhash

from marketlake.llm import simhash

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(prints, radius=4):
    """Components over all pairs; ``prints``: id to fingerprint."""
    parent = {i: i for i in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: top(i) for i in prints}


def test_against_brute_force(docs):
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in brute_force(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_copies(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for n in range(1, 5):
        for _ in range(2000):
            unlike = sum(1 << b for b in rng.sample(range(64), n))
            assert any(not m & unlike for m in masks)
    for first, second in list(zip(masks, simhash._second_masks(masks, 4)))[::10]:
        free = [b for b in range(64) if not first >> b & 1]
        for _ in range(500):
            unlike = sum(1 << b for b in rng.sample(free, 4))
            assert any(not m & unlike for m in second) and all(m & first == first for m in second)


def test_crowded_buckets(spark):
    """Buckets above the limit, over several Arrow batches, give the same components as all pairs."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(900):
        base = centres[min(i % 9, 5)]
        for b in rng.sample(range(64), rng.randrange(9)):
            base ^= 1 << b
        prints[i] = base
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "least long, print long")
    want = brute_force(prints)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        for crowd in (50, 4096):
            found = simhash.components(simhash.links(nodes, crowd=crowd)).collect()
            got = {i: i for i in prints} | {r["node"]["least"]: r["component"]["least"] for r in found}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(set(want.values())) < 850


def test_a_walk_enters_each_member_once():
    prints = np.array([0, 1, 3, 7, 0xFFFF, 0x1FFFF, 15], np.uint64)
    members, origins = simhash.walked(prints, 1)
    assert sorted(members.tolist()) == [1, 2, 3, 5, 6] and len(origins) == 5
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 1 for a, b in zip(members, origins))


def test_odd_rows(odd, empty):
    rows = simhash.near_copies(odd).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None and by_id[None]["fingerprint"] == f"{plain_print('alone without an id'):016x}"
    assert all(by_id[i]["fingerprint"] == "0" * 16 and by_id[i]["component_id"] == 1 for i in (1, 2, 3))
    assert by_id[5]["component_id"] == by_id[6]["component_id"] == 4
    assert by_id[8]["fingerprint"] == f"{plain_print('Stretched' * 30_000):016x}"
    assert simhash.near_copies(empty).count() == 0


def test_id_with_several_texts_stays_several_documents(spark):
    rows = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "u v w x y z"), (4, "u v w x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (9, 1), (9, 4), (4, 4)}
