"""From raw documents to encoded training text, in five stages.

Each stage is a function of (spark, docs, sf_dir): it works on every row of ``docs`` and returns the columns of documents,
the last one the encoded texts. Between two stages the rows are a Parquet table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from marketlake.llm.common import read_documents, read_table, stored

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labels, scores below 0.5."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the longest, then the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source has the same expected number of code points, in random order."""
    return mixing.mixed(docs, number=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with digests of the ids and of the bytes that they decode to."""
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary)
    return bpe.digests(encoded.select("doc_id", "source", "ids"), vocabulary).select(
        "doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"
    )


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode),
]

#: No SQL twin: a trained machine, connected components and byte-pair merges have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
