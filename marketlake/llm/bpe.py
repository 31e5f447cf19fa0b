"""Byte-level BPE encoding and decoding with a given rank file, long texts in overlapping chunks.

Short texts are encoded where they are read. Long ones are cut into chunks that overlap, spread over the cluster and
pre-tokenised each for itself. Two neighbours are stitched at the first place in their overlap where both see the end of a
pre-token: as the pattern never looks back, both then agree on all that follows. The pieces between the stitches are encoded
in parallel and joined in order. Where neighbours never agree (a single run longer than the overlap), the text is encoded as
one piece. Decoding concatenates the bytes of the ids.

The rank file is a parameter; nothing is trained and no file is kept here.

Defined cases: a null text counts as empty and has no ids; ids that are null decode to no bytes. Rows that repeat are encoded
each. Special tokens are ordinary text. Other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlake.llm.common import stored, text_or_empty, width

__all__ = ["CHUNK", "Vocabulary", "decode", "digests", "encode"]

#: Code points of a chunk, and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Ends of pre-tokens closer than this to a chunk's end may depend on what follows it.
GUARD = 16


class Vocabulary:
    """The ranks of a file in tiktoken's format and the pattern that splits a text before the merges."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        self._made: tuple | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_made": None}

    def _open(self) -> tuple:
        if self._made is None:
            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoder = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            pieces = {rank: piece for piece, rank in ranks.items()}
            self._made = encoder, pieces, regex.compile(self.pattern)
        return self._made

    def encode(self, text: str) -> list[int]:
        return self._open()[0].encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._open()[1].__getitem__, ids))

    def ends(self, text: str) -> list[int]:
        """Where pre-tokens end after a character that is not blank: a cut there changes no pre-token before it."""
        return [m.end() for m in self._open()[2].finditer(text) if not text[m.end() - 1].isspace()]


def chunk_bounds(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of the chunks of a text; each overlaps the next by ``overlap``."""
    step = chunk - overlap
    last = max(1, -(-(length - overlap) // step))
    return [(k * step, min(length, k * step + chunk)) for k in range(last)]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, start, length, part): the chunks of the long texts; ``docs``: row, text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for k, (start, end) in enumerate(chunk_bounds(len(text), chunk, overlap)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "k": [k], "start": [start], "length": [len(text)], "part": [text[start:end]]}, schema=fields)

    fields = pa.schema([("row", pa.string()), ("k", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("part", pa.string())])
    return docs.mapInArrow(over, "row string, k long, start long, length long, part string")


def _with_ends(chunks: DataFrame, vocabulary: Vocabulary, overlap: int) -> DataFrame:
    """The chunks with the ends of pre-tokens (from the start of the text) in the overlap before (head) and behind (tail)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, length, part in zip(batch["start"].to_pylist(), batch["length"].to_pylist(), batch["part"].to_pylist()):
                ends = np.array(vocabulary.ends(part), np.int64)
                if start + len(part) < length:
                    ends = ends[ends <= len(part) - GUARD]
                heads.append(ends[ends < overlap] + start if start else ends[:0])
                tails.append(ends[ends > len(part) - overlap] + start if start + len(part) < length else ends[:0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    return chunks.mapInArrow(over, "row string, k long, start long, length long, part string, head array<long>, tail array<long>")


def _long(docs: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of the long texts, encoded in pieces."""
    spread = _chunks(docs, chunk, overlap).repartition(width(docs.sparkSession), "row", "k")
    chunks = stored(_with_ends(spread, vocabulary, overlap))
    here, after = chunks.select("row", "k", "length", "tail"), chunks.select("row", (F.col("k") - 1).alias("k"), "head")
    met = here.join(after, ["row", "k"], "left").select("row", "k", "length", F.array_min(F.array_intersect("tail", "head")).alias("to"), F.col("head").isNull().alias("last"))
    torn = met.filter("not last and to is null").select("row").distinct()
    cuts = met.join(torn, "row", "left_anti").select("row", "k", F.coalesce("to", "length").alias("to"))
    # each piece runs from the cut before to its own; its text lies within its chunk
    before = cuts.select("row", (F.col("k") + 1).alias("k"), F.col("to").alias("from"))
    pieces = chunks.select("row", "k", "start", "part").join(cuts, ["row", "k"]).join(before, ["row", "k"], "left")
    pieces = pieces.select("row", "k", "part", (F.coalesce("from", F.lit(0)) - F.col("start")).alias("from"), (F.col("to") - F.col("start")).alias("to"))
    whole = docs.join(torn, "row", "left_semi").select("row", F.lit(0).cast("long").alias("k"), F.col("text").alias("part"), F.lit(0).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ks, parts, froms, tos = (c.to_pylist() for c in batch.columns)
            ids = [vocabulary.encode(p[a:b]) for p, a, b in zip(parts, froms, tos)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(ks, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["row", "k", "ids"])

    encoded = pieces.union(whole).mapInArrow(over, "row string, k long, ids array<int>")
    joined = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("pieces"))
    return joined.select("row", F.flatten("pieces.ids").alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>); a column of that name is replaced.

    Long texts are told apart by a digest: one that repeats is encoded once. The ids of one text meet in one row.
    """
    rest = [c for c in docs.columns if c.lower() != "ids"]
    rows = docs.select(*rest, text_or_empty(text).alias("__own"))
    is_long = F.char_length("__own") > chunk
    short, long = rows.filter(~is_long), rows.filter(is_long).withColumn("__sha", F.sha2("__own", 256))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = pa.array([vocabulary.encode(t) for t in part.column(part.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    schema = T.StructType([*short.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    texts = long.groupBy(F.col("__sha").alias("row")).agg(F.first("__own").alias("text"))
    far = long.drop("__own").join(_long(texts, vocabulary, chunk, overlap), F.col("__sha") == F.col("row"))
    return short.mapInArrow(over, schema).unionByName(far.select(*rest, "ids"))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of a column of ids."""

    def over(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([b"" if x is None else vocabulary.decode(x.tolist()) for x in part], dtype=object)

    over.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(over, "binary")(ids)


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the ids as decimal numbers, a blank between each two) and decoded_sha256 (of the decoded bytes)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, told, back = [], [], []
                for ids in part.column(at):
                    ids = ids.as_py() or []
                    n.append(len(ids))
                    told.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(told), pa.array(back)], names=[*part.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return encoded.mapInArrow(over, T.StructType([*encoded.schema.fields, *added]))
