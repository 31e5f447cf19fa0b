"""The registered queries of this package, each over whole tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.llm import alignment, bpe, exact_dedup, imatch, licenses, mixing, near_dedup, pii, quality, ranked, secrets, simhash, toxicity
from marketlake.llm.common import held_out, read_documents, read_table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["ORACLES", "QUERIES"]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same expected number of code points."""
    return mixing.mixed(read_documents(spark, sf_dir))


OP2_SQL = r"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS n FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN n > 0 THEN sum(n) OVER () / count(*) OVER () / n ELSE 1 END AS rate FROM sizes),
steps AS (
  SELECT source, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS step
  FROM rates, range(0, 100) AS r(k)),
drawn AS (SELECT *, ('0x' || substr(md5('17:' || doc_id || ':0'), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS times
  FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.step <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('17:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM counted)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(read_documents(spark, sf_dir)).drop("bucket", "chain")


OP3_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM plain
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scores(read_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words, similarity 0.8."""
    return near_dedup.near_copies(read_documents(spark, sf_dir), size=2, percent=80).drop("n_links")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.scores(text_or_empty(), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read_documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(read_documents(spark, sf_dir).select("doc_id", "text"), vocabulary)
    return bpe.digests(encoded.select("doc_id", "ids"), vocabulary).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources, repositories the sources' parts in one language."""
    return secrets.find_secrets(read_documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level vocabulary against the pieces."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as spec, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        a, b = alignment.ByteLevel(spec.read(), public_tokenizers.PATTERN), alignment.Pieces(model.read())
    return alignment.align(read_documents(spark, sf_dir), a, b)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked.rank_documents(read_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH tokens AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, * FROM documents)),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n FROM tokens GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
normed AS (SELECT row, 100 - 50 + (50 * n * docs) // terms AS m FROM sizes, totals),
scored AS (
  SELECT a.item_id, c.row, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked a JOIN weighed USING (term) JOIN counts c USING (term) JOIN normed USING (row) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS "rank", doc_id, score
FROM scored WHERE score > 0 QUALIFY "rank" <= 50
"""


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, fingerprints within four bits."""
    return simhash.near_copies(read_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan, "op2_mix_sources": op2_mix_sources, "op3_exact_dedup": op3_exact_dedup, "op5_near_dedup": op5_near_dedup, "op6_toxicity": op6_toxicity,
    "op4_quality": op4_quality, "op7_pii": op7_pii, "op8_fingerprints": op8_fingerprints, "op9_byte_bpe": op9_byte_bpe, "op10_secrets": op10_secrets,
    "op11_alignment": op11_alignment, "op12_ranked_search": op12_ranked_search, "op13_simhash_dedup": op13_simhash_dedup,
}

ORACLES: dict[str, str] = {"op1_license_scan": licenses.scan_sql(), "op2_mix_sources": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op12_ranked_search": OP12_SQL}
