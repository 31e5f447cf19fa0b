"""Exact duplicates through an extendible-hash index on shared files.

Every text, less its white space, gets a 64-bit hash. Buckets are ranges of leading hash bits: the directory starts with
few bits and doubles while a bucket holds more keys than its capacity, so that dense ranges are split and sparse ones are
not. Owner tasks take key ranges, walk their rows in key order, chain texts that collide on a key and tell them apart by
comparing bytes. Copies meet their like within each batch already, so a group of any size sends few texts to its owner,
each with its number of rows and the best of them.

Three small tables lie in the shared folder (``spark.checkpoint.dir``): entries (id, key, digest), the directory, and the
chains with the size of each group and the row that stays. None holds whole texts, and nothing is gathered on the driver but
a count.

Defined cases: a null text counts as empty, and empty texts are equal to each other. An id that is null loses a tie. Rows
that repeat an id with equal text get a decision row each, all alike; :func:`drop_exact_copies` leaves one of them. An empty
table gives an empty result. Other columns are ignored by the index and passed through by :func:`drop_exact_copies`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlake.llm.common import release, stored, text_or_empty, width

__all__ = ["build_index", "directory", "drop_exact_copies", "exact_copies"]

#: Deleted before texts are compared: the bytes of ``[\x20\x09-\x0D]``.
BLANKS = b" \t\n\x0b\x0c\r"

#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 512

#: Bits of the hash that the directory uses at most.
MOST_BITS = 40

KeyOf = Callable[[bytes], int]


def _key64(text: bytes) -> int:
    """The hash of a text as a signed 64-bit number."""
    return (xxhash.xxh3_64_intdigest(text) ^ (1 << 63)) - (1 << 63)


def _normal(column: pa.Array) -> list[bytes]:
    return [b.translate(None, BLANKS) for b in column.cast(pa.binary()).to_pylist()]


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _entries(docs: DataFrame, doc_id: str, text: str, key_of: KeyOf) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("sha", T.BinaryType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                ids, texts = batch.slice(start, 1024).columns
                plain = _normal(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([key_of(b) for b in plain], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in plain], pa.binary())],
                    names=["id", "key", "sha"],
                )
                release()

    return rows.mapInArrow(over, schema)


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(slot, bucket, bits) for every slot in use, and the directory's depth in bits.

    ``keys``: a column ``key``, distinct. A bucket is named by its leading bits, aligned left; ``bits`` is how many it uses.
    A doubling looks one bit further into the buckets that are too full, and only into those.
    """
    n = keys.count()
    depth = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n) / capacity))) + 3)
    # uniform keys fill a bucket to an eighth of its capacity here: deeper levels are asked for only where keys are not uniform
    while True:
        leaves = keys.groupBy(_leading(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("held"))
        full = leaves.filter(F.col("held") > capacity).limit(1).count()
        if not full or depth >= MOST_BITS:
            break
        depth = min(MOST_BITS, depth + 2)
    levels = leaves.select("slot", "held", F.explode(F.array([F.lit(b) for b in range(depth + 1)])).alias("bits"))
    prefix = F.expr(f"shiftleft(shiftright(slot, {depth} - bits), {depth} - bits)")
    sums = levels.groupBy("bits", prefix.alias("bucket")).agg(F.sum("held").alias("held"))
    fits = sums.filter((F.col("held") <= capacity) | (F.col("bits") == depth)).select("bits", "bucket")
    first = levels.select("slot", "bits", prefix.alias("bucket")).join(fits, ["bits", "bucket"]).groupBy("slot").agg(F.min(F.struct("bits", "bucket")).alias("at"))
    return first.select("slot", F.col("at.bucket").alias("bucket"), F.col("at.bits").alias("bits")), depth


def _chains(docs: DataFrame, doc_id: str, text: str, depth: int, key_of: KeyOf) -> DataFrame:
    """(key, chain, sha, group_size, keep_id, slot): each different text of each key, numbered within its key by digest,
    with how many rows have it and the id of the one that stays. Rows join a link of the chain when their bytes are equal."""
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    of_id = rows.schema["id"].dataType
    sent = T.StructType([T.StructField("key", T.LongType()), T.StructField("plain", T.BinaryType()), T.StructField("rows", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("id", of_id)])
    page = T.StructType([T.StructField("key", T.LongType()), T.StructField("chain", T.IntegerType()), T.StructField("sha", T.BinaryType()), T.StructField("group_size", T.LongType()), T.StructField("keep_id", of_id)])

    def rank(n: int, row_id: object) -> tuple:
        return -n, row_id is None, row_id

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                ids, texts = batch.slice(start, 2048).columns
                met: dict[bytes, tuple[int, tuple]] = {}
                for plain, n, row_id in zip(_normal(texts), pc.utf8_length(texts).to_pylist(), ids.to_pylist()):
                    count, best = met.get(plain, (0, rank(n, row_id)))
                    met[plain] = count + 1, min(best, rank(n, row_id))
                counts, best = [c for c, _ in met.values()], [r for _, r in met.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key_of(b) for b in met], pa.int64()), pa.array(list(met), pa.binary()), pa.array(counts, pa.int64()), pa.array([-r[0] for r in best], pa.int32()), pa.array([r[2] for r in best], ids.type)],
                    names=["key", "plain", "rows", "n", "id"],
                )
                release()

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        chain: list[list] = []  # [bytes, rows, rank] of each different text of the key walked
        out: list[tuple] = []

        def close() -> None:
            links = sorted((hashlib.sha256(plain).digest(), rows, best[2]) for plain, rows, best in chain)
            out.extend((at, i, *link) for i, link in enumerate(links))

        def drained(id_type: pa.DataType) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), id_type))], names=page.names)
            out.clear()
            return made

        id_type = None
        for batch in batches:
            id_type = batch.column(4).type
            for key, plain, rows, n, row_id in zip(*[c.to_pylist() for c in batch.columns]):
                if key != at:
                    if chain:
                        close()
                    at, chain = key, []
                link = next((held for held in chain if held[0] == plain), None)
                if link is None:
                    chain.append([plain, rows, rank(n, row_id)])
                else:
                    link[1], link[2] = link[1] + rows, min(link[2], rank(n, row_id))
            if out:
                yield drained(id_type)
        if chain:
            close()
            yield drained(id_type)

    owned = rows.mapInArrow(once, sent).repartition(width(docs.sparkSession), _leading(F.col("key"), depth))
    found = owned.sortWithinPartitions("key").mapInArrow(owner, page)
    return found.withColumn("slot", _leading(F.col("key"), depth))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS, key_of: KeyOf = _key64) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs``: its entries (id, key, sha), and its pages (key, sha, chain, bucket, group_size, keep_id)."""
    entries = stored(_entries(docs, doc_id, text, key_of))
    slots, depth = directory(entries.select("key").distinct(), capacity)
    pages = stored(_chains(docs, doc_id, text, depth, key_of).join(stored(slots), "slot").drop("slot", "bits"))
    return entries, pages


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS, key_of: KeyOf = _key64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its place in the index (bucket, chain).

    Of equal texts the one with the most code points stays, of those the one with the smallest id. Both this choice and the
    size of a group are what the owner of a key found along its chain; a row looks its link up by key and digest.
    """
    entries, pages = build_index(docs, doc_id, text, capacity, key_of)
    return entries.join(pages, ["key", "sha"]).select(
        F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the copies, with all its columns; of rows that repeat an id and text, one."""
    kept = exact_copies(docs, doc_id, text).filter("kept").select(F.col(doc_id).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.regexp_replace(text_or_empty(text), "[ \\t-\\r]+", "").cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_own"), sha.alias("_digest"))
    found = rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")))
    return found.dropDuplicates(["_own", "_digest"]).select("_row.*")
