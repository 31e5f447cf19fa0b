import random
import re
from collections import Counter, defaultdict

import numpy as np

from marketlake.llm import near_dedup
from marketlake.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_force(texts, size, percent=80):
    """Components by a complete join on the rarest shingles of each set, which no pair at the threshold escapes."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    rare = Counter(x for s in sets.values() for x in s)
    parent, seen, holders = {i: i for i in sets}, set(), defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        order = sorted(s, key=lambda x: (rare[x], x))
        for x in order[: len(order) - -(-percent * len(order) // 100) + 1]:
            seen.update((j, i) for j in holders[x])
            holders[x].append(i)
    for a, b in seen:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def check(docs, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_copies(docs, size=size).collect()}
    assert got == brute_force({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, size)
    return got


def test_against_brute_force(docs):
    check(docs, 2)
    check(docs, 5)


def test_group_whose_members_are_not_all_alike(spark):
    """Drifting copies: neighbours are alike, ends are not, and blocks split the group."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words[rng.randrange(60)] = f"n{i}"
        rows.append((i * 7 % 240, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 16
    try:
        found = check(docs, 2)
    finally:
        near_dedup.BLOCK = old
    assert len({c for _, c in found.values()}) < 240


def test_odd_rows(odd, empty):
    rows = near_dedup.near_copies(odd, size=2).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (1, 2, 3))
    assert by_id[5]["component_id"] == by_id[6]["component_id"] == 4 and by_id[7]["n_shingles"] == 1
    kept = near_dedup.drop_near_copies(odd, size=2)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert near_dedup.near_copies(empty).count() == 0


def test_id_with_several_texts_is_one_node(spark):
    rows = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "u v w x y z"), (4, "u v w x y z")]
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["component_id"] for r in got} == {1}


def test_id_with_many_texts_ties_all_of_them(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(6)) for k in range(5)]
    rows = [(k + 1, texts[k]) for k in range(5)] + [(9, t) for t in texts] + [(7, "u v w x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == {*((k, 1) for k in (1, 2, 3, 4, 5, 9)), (7, 7)}


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(5)
    factors, offsets = near_dedup._constants()
    most, wrong = near_dedup._screen(0.8), 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = base[:450], base[50:]
        sketches = [near_dedup.odd_sketch(near_dedup.minhashes(x, factors, offsets)) for x in (a, b)]
        wrong += int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) > most
    assert not wrong and most < 0.45 * 64 * near_dedup.SKETCH_WORDS


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 1), (8, 7), (7, 7), (3, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 1, 4: 1, 5: 1, 8: 7, 21: 20, 22: 20, 23: 20, 24: 20}
