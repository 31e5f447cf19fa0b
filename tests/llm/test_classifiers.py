import numpy as np
from pyspark.sql import functions as F

from marketlake.llm import quality, toxicity
from marketlake.llm.common import held_out, read_table, text_or_empty

LARGER = "/root/testdata/sf0.1"
TABLE = toxicity._code_table()


def test_string_kernel_is_the_sum_over_common_triples():
    def triples(word):
        out = {}
        symbols = [0, *(ord(c) - 96 for c in word), 0]
        for i in range(len(symbols)):
            for j, k in toxicity.STEPS:
                if i + j + k < len(symbols):
                    t = symbols[i], symbols[i + j], symbols[i + j + k]
                    out[t] = out.get(t, 0) + toxicity.DECAY ** (j + k)
        return out

    weights = np.random.default_rng(1).normal(size=toxicity.SYMBOLS**3).astype(np.float32)
    model = toxicity.Model(weights, 0.0, None)
    words = ["abc", "kernel", "z", "stretched"]
    values, of, _ = model.words([" ".join(words), "", "kernel"], TABLE)
    want = [sum(weights[(a * 64 + b) * 64 + c] * v for (a, b, c), v in triples(w).items()) / toxicity._norms(20)[len(w)] for w in words]
    assert of.tolist() == [0, 0, 0, 0, 2] and np.allclose(values, [*want, want[1]], atol=1e-4)


def test_symbols_join_marks_and_single_letters():
    codes, _ = toxicity._symbols(["i d i o t", "i.d-i o", "İx 9"], TABLE)
    words = [w.tolist() for w in np.split(codes, np.flatnonzero(codes == 0))[1:-1]]
    assert words[0] == [0, 9, 4, 9, 15, 20] and words[1] == [0, 9, 4, 9] and words[2] == [0, 15] and len(words) == 5


def test_toxicity_on_held_out_labels(spark):
    docs, labels = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    model = toxicity.fit(docs, labels)
    got = docs.join(labels, "doc_id").select(held_out().alias("held_out"), "toxic", toxicity.scores(text_or_empty(), model).alias("score")).filter("held_out").toPandas()
    said = got.score >= 0.5
    assert ((said == (got.toxic == 1)).mean()) >= 0.98
    assert (said & (got.toxic == 0)).sum() <= 5 and (said & (got.toxic == 1)).sum() >= 0.88 * (got.toxic == 1).sum()
    plain, gapped, clean = model.score(["what an idiot, pathetic", "what an i.d.i.o.t, pa-thetic", "a nice morning"], TABLE)
    assert plain > 0.5 and gapped > 0.5 and clean < 0.2
    single = model.score([f"so he went on to the market again, {w}, and bought what was left of the bread" for w in ("idiot", "s.t.u.p.i.d", "pathetic", "MORON")], TABLE)
    assert (single > 0.5).all()  # though labelled documents have several each


def test_toxicity_with_some_wrong_labels(spark):
    docs, labels = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    wrong = labels.withColumn("toxic", F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(100)) < 3, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, wrong)
    got = docs.join(labels, "doc_id").select(held_out().alias("held_out"), "toxic", toxicity.scores(text_or_empty(), model).alias("score")).filter("held_out").toPandas()
    said = got.score >= 0.5
    assert (said & (got.toxic == 1)).sum() >= 0.85 * (got.toxic == 1).sum() and (said & (got.toxic == 0)).sum() <= 0.025 * (got.toxic == 0).sum()


def test_toxicity_odd_rows(odd, empty, docs, labels):
    model = toxicity.fit(docs, labels)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert odd.select(toxicity.scores(text_or_empty(), model).alias("s")).filter("s between 0 and 1").count() == 13
    assert toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).score(["any"], TABLE).tolist() == [0.0]


def test_quality_on_held_out_labels(spark):
    docs, labels = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    got = quality.scores(docs, labels).join(labels, "doc_id").filter(held_out()).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() >= 0.98
    assert (got.score[got.quality == 1] < 0.3).sum() <= 1


def test_quality_odd_rows(odd, empty, docs, labels):
    assert quality.scores(odd, labels).filter("score between 0 and 1").count() == 13
    assert quality.scores(empty, labels).count() == 0
    assert quality.statistics(b"").sum() == 0


def test_isotonic_regression():
    y = np.array([0.0, 0.5, 0.2, 0.4, 1.0, 0.9])
    assert np.allclose(quality.isotonic(y, np.ones(6)), [0, 0.35, 0.35, 0.4, 0.95, 0.95])


def test_normal_equations_do_not_depend_on_partitions(docs, labels):
    a = quality.scores(docs.repartition(1), labels).toPandas().sort_values("doc_id").score.values
    b = quality.scores(docs.repartition(7), labels).toPandas().sort_values("doc_id").score.values
    assert np.allclose(a, b, atol=1e-6)
