"""Byte-pair encoding, fingerprints, mixing."""

import hashlib
import math
import random
import re
import time

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from marketlake.llm import bpe, imatch, mixing
from marketlake.llm.common import stored_alone

VOCABULARY = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_encoding_equals_the_library_at_any_chunk_size(docs, odd):
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(odd.sparkSession.createDataFrame([(-1, "ab 12\n\n  don't  é\U0001F600 " * 700), (-2, " \n" * 3000), (-3, "a" * 5000), (-4, "x\n\n\ny" * 1500)], "doc_id long, text string"))
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (1000, 100), (300, 40)):
        got = bpe.encode(every, VOCABULARY, chunk=chunk, overlap=overlap).select("text", "ids", bpe.decode(F.col("ids"), VOCABULARY).alias("back")).collect()
        assert len(got) == every.count()
        for r in got:
            assert r["ids"] == VOCABULARY.encode(r["text"] or "") and bytes(r["back"]).decode() == (r["text"] or "")


def test_library_as_the_contract_has_it():
    assert isinstance(VOCABULARY._open()[0], tiktoken.Encoding)
    assert VOCABULARY.encode("<|endoftext|>") and VOCABULARY.decode(VOCABULARY.encode("é😀 x")) == "é😀 x".encode()


def test_encoding_keeps_other_columns(odd, empty):
    got = bpe.encode(odd, VOCABULARY)
    assert set(got.columns) == set(odd.columns) and dict(got.dtypes)["ids"] == "array<int>"
    assert bpe.encode(empty, VOCABULARY).count() == 0


def test_chunks_cover_a_text():
    for n in (1, 99, 100, 101, 190, 191, 1000):
        bounds = bpe.chunk_bounds(n, 100, 10)
        assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] - b[0] == 10 for a, b in zip(bounds, bounds[1:]))


def fingerprint_rows(docs):
    return sorted(((r["doc_id"], r["fingerprint"], r) for r in imatch.fingerprints(docs).collect()), key=lambda x: x[0])


def test_fingerprints_against_brute_force(docs):
    for frame in (docs, docs.orderBy("text").repartition(5).filter("doc_id % 3 != 1")):
        rows = sorted(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect())
        got = fingerprint_rows(frame)
        known = {}
        for r in rows:
            for w in set(r["t"].encode().lower().split()):
                known[w] = known.get(w, 0) + 1
        band = {w for w, n in known.items() if imatch.LEAST_DF <= n <= imatch.MOST_SHARE * len(rows)}

        def print_of(text):
            import numpy as np

            words = set(text.encode().lower().split())
            hashes = imatch._terms(b" ".join(w for w in words if w in band), {})
            level = imatch._level(len(words))
            return imatch._print(imatch._sampled(np.sort(hashes), level), level)

        for i, (doc_id, own, r) in enumerate(got):
            text, after = rows[i]["t"], rows[(i + 1) % len(rows)]["t"]
            changed = imatch.edited(text, after)
            assert (doc_id, r["n_chars"]) == (rows[i]["doc_id"], len(text)) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert own == print_of(text) and r["edited_fingerprint"] == print_of(changed)
            assert r["near_edited"] == imatch.likeness(own, r["edited_fingerprint"]) and r["near_next"] == imatch.likeness(own, got[(i + 1) % len(got)][1])
        edited, following = (sum(r[c] for *_, r in got) / len(got) for c in ("near_edited", "near_next"))
        assert edited > 0.3 and following < 0.1


def test_copies_keep_their_fingerprints(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(4000)]
    copied = " ".join(rng.sample(words, 120))
    rows = [(i, copied if i % 3 == 0 else " ".join(rng.sample(words, 120))) for i in range(300)]
    rows.append((299_000, copied))
    rows.append((299_001, copied))
    got = fingerprint_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {own for (i, own, _), (_, t) in zip(got, rows) if t == copied}
    assert len(groups) == 1 and groups != {""}
    assert sum(r["near_edited"] for (*_, r), (_, t) in zip(got, rows) if t == copied) / 102 > 0.2
    assert next(r["near_next"] for i, _, r in got if i == 299_000) == 1


def test_terms_outside_the_lexicons_at_the_first_level(spark):
    level = imatch._level(1000)
    shared = [w for w in (f"shared{i}" for i in range(60)) if not len(imatch._sampled(imatch._terms(w.encode(), {}), level))][:20]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(980)])) for k in range(2)] + [(9 + i, f"other{i}") for i in range(40)]
    got = {i: r for i, _, r in fingerprint_rows(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != "" and got[0]["near_next"] == 1
    assert got[0]["edited_fingerprint"] and got[0]["near_edited"] > 0 and got[9]["fingerprint"] == ""


def test_equal_texts_before_different_followers(spark):
    """Texts with few terms in the band, and such that their edited forms have few: what follows a text changes nothing in its print."""
    rng = random.Random(7)
    common, frequent = [f"common{i}" for i in range(400)], [f"frequent{i}" for i in range(1200)]
    rows, number = [], 0
    for k in range(24):
        few = rng.sample(common, rng.choice([2, 3, 20, 60]))  # in the band; the frequent ones are in most texts
        text = rng.sample(frequent, 1000 if k % 6 else 3) + few
        rng.shuffle(text)
        for _ in range(3):
            rows.append((number, " ".join(text)))
            rows.append((number + 1, " ".join(f"tail{number}x{i}" for i in range(rng.choice([1, 50, 3000])))))
            number += 2
    got = {i: r for i, _, r in fingerprint_rows(spark.createDataFrame(rows, "doc_id long, text string"))}
    prints = {}
    for i, t in rows:
        prints.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    copies = [t for t in prints if "common" in t]
    starts = {int(next(iter(prints[t])).split(":")[0]) - imatch._level(len(t.split())) for t in copies}
    assert len(copies) == 24 and min(starts) < 0 and max(starts) == 0  # both branches


def test_fingerprints_of_odd_rows(odd, empty):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == 13 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert imatch.fingerprints(empty).count() == 0 and imatch.fingerprints(odd.filter("doc_id = 4")).first()["near_next"] == 0
    assert imatch.likeness("", "0:a") == 0 and imatch.likeness("0:a,b;1:a,", "1:a,;2:,") == 1


def poisson_count(u, rate):
    p = total = math.exp(-rate)
    k = 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_are_the_inverse_distribution(docs):
    table = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    want = {}
    for r in docs.select("doc_id", "source").collect():
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}:0".encode()).hexdigest()[:13], 16) / 2**52
        if n := poisson_count(u, table[r["source"]]):
            want[r["doc_id"]] = n
    got = {}
    keys = []
    for r in mixing.mixed(docs).select("doc_id", "copy", "shuffle_key").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        keys.append(r["shuffle_key"])
    assert got == want and keys == sorted(keys)


def test_target_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "repeat('x', 10) as text")
    mixed = {r["source"]: r["count"] for r in mixing.mixed(docs, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert abs(mixed["a"] / 4500 - 1) < 0.05 and abs(mixed["b"] / 1500 - 1) < 0.08
    only = mixing.mixed(docs, {"a": 1})
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"a"}
    few = docs.filter("doc_id < 30").union(spark.sql("select 99999, 'tiny', 'y'"))
    many = mixing.mixed(few, {"tiny": 1}).count()
    assert abs(many - 301) < 80


def test_mixing_odd_rows(odd, empty):
    got = mixing.mixed(odd, number=False)
    assert got.columns == odd.columns
    numbered = mixing.mixed(odd)
    assert dict(numbered.dtypes)["copy"] == "int" and len(numbered.columns) == len(odd.columns)
    assert mixing.mixed(empty).count() == 0
    assert re.fullmatch("[0-9a-f]{32}", numbered.first()["shuffle_key"])


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_no_shuffle_files_stay_behind_a_stored_table(spark, docs):
    before, setting = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    table = stored_alone(imatch.frequencies(docs))
    end = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(setting, None) == was
    assert table.agg(F.sum("df")).first()[0] > 0  # the written table does not need them


def test_terms_of_an_edit_are_those_of_both_texts():
    texts = ["", "a", "one two three four", "  lead  and trail ", "ONE\ttwo\vthree\ffour\rfive\nsix", "nowordbreakatallinthistext", "é😀 ça va é😀 bien", "x " * 40, "\ud800 alone a b c"]
    for text in texts:
        for following in texts:
            changed = imatch.edited(text, following)
            plain, other = (t.encode("utf-8", "surrogatepass") for t in (text, changed))
            same = len(text[: len(text) - len(text) // 4].encode("utf-8", "surrogatepass"))
            found, end, start = imatch._both_terms(plain, other, same, {})
            assert sorted(found[:end]) == sorted(imatch._terms(plain, {})) and sorted(found[start:]) == sorted(imatch._terms(other, {}))
