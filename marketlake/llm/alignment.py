"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

A text's bytes are cut into tokens twice. Token-byte incidence matrices A and B hold a row for each token and a column for each
byte, as hand-built compressed rows (``Rows``). Gustavson's row-by-row product A * B^T has an entry for each pair of tokens whose
byte ranges overlap, with the number of shared bytes: the overlap links. Where tokens of both end at one byte, a group ends;
the product of the tokens' group incidences has an entry for each pair within a group: the shared-group links.

Documents are worked on in slices of bounded size. A slice keeps its distinct id pairs once, and per document which of them it
has and how often. What is counted over the corpus (how many documents hold a pair linked, and the highest such count of each
A id) is summed from the slices' pairs, and each slice asks for the counts of its own pairs only; no table of all pairs goes to a
task.

Defined cases: texts that are null or empty, and texts whose joined tokens differ from a space and the text in either
tokenizer, have no tokens: zeros and an empty string. A null id counts as any other; rows that repeat count as documents of
their own. Special tokens in a text are plain text. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marketlake.llm.common import release, stored, text_or_empty

__all__ = ["ByteLevel", "Pieces", "Rows", "align", "row_products", "token_links", "transposed"]

#: Bytes of text and documents of a slice; a longer text is a slice of its own.
SLICE_BYTES, SLICE_DOCS = 400_000, 512
#: Rows of A that are multiplied at once.
BLOCK_ROWS = 1 << 17


class Rows(NamedTuple):
    """A sparse matrix of ones by compressed rows: row i has its entries in the columns ``at[start[i]:start[i + 1]]``."""

    start: np.ndarray
    at: np.ndarray

    def block(self, low: int, high: int) -> Rows:
        return Rows(self.start[low : high + 1] - self.start[low], self.at[self.start[low] : self.start[high]])


def tiled(ends: np.ndarray) -> Rows:
    """Token-byte incidence of tokens that tile the bytes: each has those from the end before to its own."""
    return Rows(np.append(0, ends), np.arange(ends[-1] if len(ends) else 0))


def transposed(x: Rows, columns: int) -> Rows:
    """Columns as rows, entries in ascending order: a counting sort by column."""
    owner = np.repeat(np.arange(len(x.start) - 1), np.diff(x.start))
    start = np.append(0, np.cumsum(np.bincount(x.at, minlength=columns)))
    return Rows(start, owner[np.argsort(x.at, kind="stable")])


def row_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Entries that each row of a * b is summed from: the symbolic half of Gustavson's product."""
    sizes = np.append(0, np.cumsum(np.diff(b.start)[a.at]))
    return sizes[a.start[1:]] - sizes[a.start[:-1]]


def row_products(a: Rows, b: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product of two matrices of ones: (row, column, value) of the entries of a * b, block by block of a's rows.

    A row of the product is the sum of those rows of b that a's row points to.
    """
    for low in range(0, len(a.start) - 1, BLOCK_ROWS):
        part = a.block(low, min(low + BLOCK_ROWS, len(a.start) - 1))
        sizes = np.diff(b.start)[part.at]
        first = np.append(0, np.cumsum(sizes))
        take = np.arange(first[-1]) + np.repeat(b.start[part.at] - first[:-1], sizes)
        row = np.repeat(np.repeat(np.arange(len(part.start) - 1), np.diff(part.start)), sizes)
        column = b.at[take]
        step = np.diff(column)
        if ((np.diff(row) == 0) & (step < 0)).any():
            by = np.lexsort((column, row))
            row, column = row[by], column[by]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (column[1:] != column[:-1]))) if len(row) else row
        yield row[new] + low, column[new], np.diff(np.append(new, len(row)))


class ByteLevel:
    """A byte-level tokenizer by its JSON file's text, which travels with the job.

    Texts of letters that both libraries class alike are encoded with the same vocabulary by the faster of them.
    """

    #: Code points below this one are classed alike (Latin, Greek, Cyrillic).
    ALIKE = 0x530

    def __init__(self, spec: str, pattern: str) -> None:
        self.spec, self.pattern, self._whole, self._fast = spec, pattern, None, None
        self.names: list[str] = []

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "pattern": self.pattern, "_whole": None, "_fast": None, "names": []}

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes of each id. Byte-level alphabets show a byte by itself where it prints, and else by 256 and its number among the rest."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = json.loads(self.spec)["model"]["vocab"]
        out = [b""] * (1 + max(vocabulary.values()))
        for name, number in vocabulary.items():
            if all(c in byte for c in name):
                out[number] = bytes(byte[c] for c in name)
        return out

    def encode(self, text: str) -> list[int]:
        if text.isascii() or max(text) < chr(self.ALIKE):
            if self._fast is None:
                special = {x["content"] for x in json.loads(self.spec).get("added_tokens", [])}
                vocabulary = json.loads(self.spec)["model"]["vocab"]
                ids = self.bytes_of_ids()
                ranks = {ids[k]: k for name, k in vocabulary.items() if name not in special}
                self._fast = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return self._fast.encode_ordinary(text)
        if self._whole is None:
            self._whole = tokenizers.Tokenizer.from_str(self.spec)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A piece tokenizer by its model's bytes, which travel with the job."""

    def __init__(self, model: bytes) -> None:
        self.model, self._made = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_made": None}

    def _open(self) -> sentencepiece.SentencePieceProcessor:
        if self._made is None:
            self._made = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._made

    def bytes_of_ids(self) -> list[bytes]:
        made = self._open()
        names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", n) for n in names]
        return [bytes([int(m[1], 16)]) if m else n.replace("▁", " ").encode() for n, m in zip(names, byte)]

    def encode(self, text: str) -> list[int]:
        return self._open().encode(text, num_threads=1)


class _Work:
    """The tables of a task, and what it does to a slice of texts."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = a.bytes_of_ids(), b.bytes_of_ids()
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.told = [*(f"{i}," for i in range(n)), *(f"{i}|" for i in range(n)), *(f"{i}," for i in range(m)), *(f"{i};" for i in range(m))]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B; none where the bytes differ."""
        if not text:
            return [], []
        spaced = " " + text
        plain = spaced.encode("utf-8", "surrogatepass")
        a = self.a.encode(spaced)
        if b"".join(map(self.bytes_a.__getitem__, a)) != plain:
            return [], []
        b = self.b.encode(text)
        return (a, b) if b"".join(map(self.bytes_b.__getitem__, b)) == plain else ([], [])

    def slice(self, texts: list[str]) -> _Slice:
        found = [self.tokens(t) for t in texts]
        return _Slice(self, [np.array(a, np.int64) for a, _ in found], [np.array(b, np.int64) for _, b in found])


class _Slice:
    """Texts side by side on one axis of bytes: a text's end is an end of tokens of both."""

    def __init__(self, work: _Work, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.work = work
        self.a, self.b = (np.concatenate(x) for x in (a, b))
        self.from_a, self.from_b = (np.append(0, np.cumsum([len(x) for x in y])) for y in (a, b))
        ends_a, ends_b = np.cumsum(work.size_a[self.a]), np.cumsum(work.size_b[self.b])
        self.rows_a, self.rows_b = tiled(ends_a), tiled(ends_b)
        self.bytes = int(ends_a[-1]) if len(ends_a) else 0
        # a byte's group: how many ends of both lie before it
        self.shut_a, self.shut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        self.group_a, self.group_b = (np.cumsum(x) - x for x in (self.shut_a, self.shut_b))
        self.groups = int(self.shut_a.sum())

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, shared bytes)."""
        return row_products(self.rows_a, transposed(self.rows_b, self.bytes))

    def group_incidences(self) -> tuple[Rows, Rows]:
        """Tokens of A by groups, and groups by tokens of B."""
        one = (Rows(np.arange(len(g) + 1), g) for g in (self.group_a, self.group_b))
        return next(one), transposed(next(one), self.groups)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per token of A, by text."""
        sums = np.append(0, np.cumsum(values))
        return sums[self.from_a[1:]] - sums[self.from_a[:-1]]

    def digests(self) -> list[str]:
        """Of the groups written out: A ids | B ids ; and so on."""
        n, m = len(self.work.bytes_a), len(self.work.bytes_b)
        in_a, in_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        line = np.empty(len(self.a) + len(self.b), np.int64)
        line[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]] = self.a + n * self.shut_a
        line[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = self.b + 2 * n + m * self.shut_b
        told, bounds = self.work.told, (self.from_a + self.from_b).tolist()
        parts = ("".join(map(told.__getitem__, line[x:y].tolist()))[:-1] for x, y in zip(bounds, bounds[1:]))
        return [hashlib.sha256(p.encode()).hexdigest() if p else "" for p in parts]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Slices of a batch (id, text): ids and texts."""
    start = held = 0
    sizes = [len(t) if t is not None else 0 for t in batch.column(1).cast(pa.binary()).to_pylist()]
    for i, size in enumerate(sizes):
        if i > start and (held + size > SLICE_BYTES or i - start == SLICE_DOCS):
            part = batch.slice(start, i - start)
            yield part.column(0), part.column(1).to_pylist()
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        part = batch.slice(start)
        yield part.column(0), part.column(1).to_pylist()


def _slices(docs: DataFrame, a: ByteLevel, b: Pieces, doc_id: str, text: str) -> DataFrame:
    """A row per slice: its documents' digests, its distinct pairs with the documents that hold each, and packed, per document, its pairs and how often."""
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    kind = rows.schema["id"].dataType
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_pairs"]
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.LongType())) for c in longs),
        T.StructField("sha", T.ArrayType(T.StringType())), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(T.IntegerType())),
        T.StructField("packed", T.BinaryType()),
    ])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, pack = _Work(a, b), zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in _texts(batch):
                one = work.slice(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(one.from_a))
                keys, counts = [np.empty(0, np.int64)], np.zeros(len(one.a), np.int64)
                of = [np.empty(0, np.int64)]
                for x, y, _ in one.overlaps():
                    keys.append(one.a[x] << 32 | one.b[y]), of.append(owner[x])
                    counts += np.bincount(x, minlength=len(one.a))
                pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
                held, times = np.unique(np.concatenate(of) * max(1, len(pairs)) + place, return_counts=True)
                at = held % max(1, len(pairs))
                small = pack.compress(np.stack([at, times]).astype(np.int32).tobytes())
                columns = [
                    np.diff(one.from_a), np.diff(one.from_b), one.per_text(one.shut_a), one.per_text(counts), one.per_text(row_sizes(*one.group_incidences())),
                    np.bincount(held // max(1, len(pairs)), minlength=len(texts)),
                ]
                listed = [pa.array([c.astype(np.int64)], pa.list_(pa.int64())) for c in columns]
                whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), whole, *listed, pa.array([one.digests()]), pa.array([pairs], pa.list_(pa.int64())),
                    pa.array([np.bincount(at, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())), pa.array([small]),
                ], names=schema.names)
                number += 1
                release()

    return rows.mapInArrow(over, schema)


def align(docs: DataFrame, a: ByteLevel, b: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    ``n_links`` counts overlap links, ``n_group_links`` pairs of tokens that share a group. ``count_sum`` sums, over the links,
    how many documents hold the link's pair of ids linked; ``n_best`` counts the links whose pair is held most often of its A id.
    """
    slices = stored(_slices(docs, a, b, doc_id, text))
    asked = slices.select("slice", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("slice", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    known = stored(counts.select("pair", "count", (F.col("count") == top).alias("best")))
    answers = asked.select("slice", "pair").join(known, "pair").groupBy("slice").agg(F.collect_list(F.struct("pair", "count", "best")).alias("known"))
    joined = slices.drop("pairs", "docs").join(answers, "slice", "left")
    kind = docs.schema[doc_id].dataType
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(doc_id, kind), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()), T.StructField("n_group_links", T.LongType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                given = {c: row[c].flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_pairs", "sha")}
                told = row["known"].flatten()
                pair, count, best = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                by = np.argsort(pair)
                count, best = count[by].astype(np.int64), best[by].astype(bool)
                at, times = np.frombuffer(unpack.decompress(row["packed"][0].as_py()), np.int32).reshape(2, -1)
                bounds = np.append(0, np.cumsum(given["n_pairs"].to_numpy()))
                sums = (np.append(0, np.cumsum(x)) for x in (times * best[at].astype(np.int64), times * count[at]))
                n_best, count_sum = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
                yield pa.RecordBatch.from_arrays([
                    given["ids"], *(given[c] for c in longs[:4]), pa.array(n_best), pa.array(count_sum), given["sha"], given["n_group_links"],
                ], names=schema.names)
                release()

    return joined.select("ids", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_pairs", "sha", "packed", "known").mapInArrow(over, schema)


def token_links(docs: DataFrame, a: ByteLevel, b: Pieces, shared_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, shared): the links themselves, by the tokens' numbers in their text, from 0.

    ``shared`` is the number of bytes that overlap; with ``shared_groups``, pairs of tokens in one group are linked and it is 1.
    """
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField(doc_id, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("a_at", "b_at", "a_id", "b_id", "shared"))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Work(a, b)
        for batch in batches:
            for ids, texts in _texts(batch):
                one = work.slice(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(one.from_a))
                for x, y, shared in row_products(*one.group_incidences()) if shared_groups else one.overlaps():
                    of = owner[x]
                    columns = (x - one.from_a[of], y - one.from_b[of], one.a[x], one.b[y], shared)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *(pa.array(c.astype(np.int64)) for c in columns)], names=schema.names)

    return rows.mapInArrow(over, schema)
