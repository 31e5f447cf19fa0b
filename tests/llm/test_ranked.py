import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marketlake.llm import queries, ranked
from marketlake.llm.common import read_table

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(docs, items, most=50):
    """Every document scored for every item; ``docs``: rows (id, text), ``items``: id to text."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items.items():
        scored = []
        for i, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(plain_terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def test_against_brute_force_and_sql(spark, docs):
    items = read_table(spark, SF_DIR, "benchmark")
    got = sorted((tuple(r) for r in ranked.rank_documents(docs, items).collect()), key=str)
    assert got == brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], dict(tuple(r) for r in items.select("item_id", "text").collect()))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    assert got == sorted((tuple(r) for r in con.execute(queries.ORACLES["op12_ranked_search"]).fetchall()), key=str)


def test_items_in_blocks(spark, docs):
    items = read_table(spark, SF_DIR, "benchmark")
    assert ranked.rank_documents(docs, items, at_once=7).exceptAll(ranked.rank_documents(docs, items)).isEmpty()


@pytest.mark.parametrize("leaf", [1, 3, 40])
def test_bounds_hold_and_search_is_exact(leaf):
    """On random trees: no document scores above a bound over it, and the heap holds the best of all documents."""
    rng, words = random.Random(leaf), 40
    vectors = [sorted(rng.sample(range(words), rng.randrange(1, 12))) for _ in range(300)]
    vectors += [vectors[3]] * 30 + [vectors[7][:2]] * 30
    tf = [[rng.choice([1, 1, 2, 9]) for _ in v] for v in vectors]
    ids, m = np.arange(len(vectors))[::-1].copy(), np.array([rng.randrange(60, 400) for _ in vectors])
    df = np.bincount(np.concatenate(vectors), minlength=words)
    order = np.empty(words, np.int32)
    order[np.argsort(-df, kind="stable")] = np.arange(words)
    weight = ranked.weights(df, len(vectors))
    tree = ranked.Tree(ids, m, np.append(0, np.cumsum([len(v) for v in vectors])), np.concatenate(vectors), np.concatenate(tf), order, leaf)
    entered = leaves = 0
    for _ in range(60):
        own = sorted(rng.sample(range(words), 6))
        scores = {int(i): sum(int(weight[t]) * (10**9 * f // (1000 * f + 20 * int(n))) for t, f in zip(v, fs) if t in own) for i, v, fs, n in zip(ids, vectors, tf, m)}
        bound = tree.bounds_of(own, weight)
        for a, b, most in zip(tree.low, tree.high, bound):
            assert max(scores[int(i)] for i in tree.ids[a:b]) <= most
        held = []
        entered += tree.search(own, weight, held, 5, np.zeros(words, bool))
        leaves += sum(not c for c in tree.children)
        want = sorted(((-s, i) for i, s in scores.items() if s > 0))[:5]
        assert sorted((-s, -i) for s, i in held) == want
    assert entered < leaves


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "six SEVEN", 1), (None, "word", 2), (3, "", 3), (4, None, 4), (5, "unknown", 5), (1, "license é😀", 6), (6, "one one two", 7)], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in ranked.rank_documents(odd, items).collect()), key=str)
    merged = {1: "six SEVEN license é😀", None: "word", 3: "", 4: "", 5: "unknown", 6: "one one two"}
    assert got == brute_force([tuple(r) for r in odd.select("doc_id", "text").collect()], merged)
    assert ranked.rank_documents(empty, items).count() == 0 and ranked.rank_documents(odd, items.limit(0)).count() == 0
    assert ranked.rank_documents(odd, items, most=2).count() == 2 + 1 + 2
