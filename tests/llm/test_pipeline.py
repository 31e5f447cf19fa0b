import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from marketlake.llm import bpe, mixing, toxicity
from marketlake.llm.common import stored
from tests.llm.conftest import SF_DIR
from tests.llm.test_near_dedup import brute_force
from tests.llm.test_texts import poisson_count

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_stages_against_brute_force(spark, docs, labels):
    steps, rows = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, SF_DIR))
        assert rows.columns == docs.columns
        steps.append(rows.collect())
    before = docs.collect()
    model, table = toxicity.fit(docs, labels), toxicity._code_table()
    clean = [r for r in before if model.score([r["text"]], table)[0] < 0.5]
    assert sorted(r["doc_id"] for r in steps[0]) == sorted(r["doc_id"] for r in clean)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(known.get(r["doc_id"]) == 0 for r in before) - sum(known.get(r["doc_id"]) == 0 for r in clean) <= 1
    best = {}
    for r in clean:
        key = r["text"].translate(BLANKS)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in steps[1]) == sorted(i for _, i in best.values())
    near = brute_force({r["doc_id"]: r["text"] for r in steps[1]}, 5)
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(i for i, (_, c) in near.items() if i == c)
    rates = {r["source"]: r["rate"] for r in mixing.rates(spark.createDataFrame(steps[2], docs.schema)).collect()}
    drawn = {r["doc_id"]: poisson_count(int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}:0".encode()).hexdigest()[:13], 16) / 2**52, rates[r["source"]]) for r in steps[2]}
    assert Counter(r["doc_id"] for r in steps[3]) == Counter({i: n for i, n in drawn.items() if n})
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], tuple(vocabulary.encode(r["text"]))) for r in steps[3])
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last) == want


def test_odd_and_empty_tables(spark, odd, empty):
    for frame in (odd, empty):
        rows = frame
        for _, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, SF_DIR))
        assert (rows.count() == 0) == (frame is empty)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 0
