"""What several text operators share: reading, identity of documents, shared intermediate tables, digests."""

from __future__ import annotations

import ctypes
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlake.session import cut_lineage

__all__ = ["arrow_map", "clear_of", "held_out", "read_documents", "read_table", "release", "stored", "stored_alone", "text_or_empty", "width"]

#: One Arrow batch is taken apart into pieces of at most this many rows, so that Python holds few texts at once.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, which stands in both Spark and Python: rows are documents of any length.
ARROW_BYTES = 4 << 20

_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _short_batches(spark: SparkSession) -> None:
    """Lower the session's bound of an Arrow batch where it is higher."""
    if int(spark.conf.get(_ARROW_LIMIT).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is a multiple of 5; an id that is null is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stored(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared folder and read again: later stages do not depend on executors that made it."""
    _short_batches(df.sparkSession)
    return cut_lineage(df)


def stored_alone(df: DataFrame) -> DataFrame:
    """``stored``, and the shuffle files behind the table go as soon as it is written: nothing reads them again, and
    they would stay on the executors' disks until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        return stored(df)
    finally:
        conf.unset(_SHUFFLES_GO) if before is None else conf.set(_SHUFFLES_GO, before)


def release() -> None:
    """Hand freed memory back: a worker outlives its task, and what it holds counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def clear_of(taken: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span (start, end) overlaps none of these; each question takes a binary search."""
    ordered = sorted(taken)
    starts = [s for s, _ in ordered]
    reach = list(accumulate((e for _, e in ordered), max))

    def clear(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return clear


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, fields: pa.Schema) -> DataFrame:
    """Apply ``rows`` (columns as lists in, columns as lists out) to slices of every Arrow batch of ``df``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                if out is not None and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out, schema=fields)

    return df.mapInArrow(over, schema)
