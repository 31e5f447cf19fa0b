"""SimHash near duplicates through covering locality-sensitive hashing.

A text's fingerprint takes a bit where more than half of its shingles' hashes have it. Equal fingerprints are one node from
there on. ``2 ** (RADIUS + 1) - 1`` tables each keep about half of the bits, by structured masks: every bit position gets a
non-zero vector of ``RADIUS + 1`` bits, and table v keeps the positions whose vector has an odd product with v. Any ``RADIUS``
positions leave some v orthogonal to all of their vectors, and that table keeps none of them. So every pair within the radius
meets in some table, none is missed, and no probability comes in.

A bucket's members are walked from one to the next within the radius, each member once, so that a bucket of m members gives
at most m - 1 links. A bucket of more than ``CROWD`` members is not walked: its rows go on, unbuffered, to a second set of
masks over the bits that the first left free. What meets there has about fifteen free bits, which bounds a bucket by itself.

Defined cases: a text that is null or without words has fingerprint zero, linked like any other; a text with fewer words than
a shingle is one shingle. A row whose id is null is linked with nothing and its component is null. Rows that repeat an id are
documents of their own: each belongs to its text's component. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from marketlake.llm.common import release, stored, text_or_empty, width
from marketlake.llm.components import components

__all__ = ["RADIUS", "covering_masks", "fingerprint", "near_copies", "walked"]

RADIUS = 4
SEED = 42
#: Members of a bucket from which it is split by further masks.
CROWD = 4096
#: Buckets up to this size are compared many at a time, larger ones one by one.
SMALL = 48
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 15

_U = np.uint64


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions, such that any ``radius`` of them lie outside some mask."""
    size = (1 << (radius + 1)) - 1
    vectors = {p: 1 + i % size for i, p in enumerate(positions)}
    return [sum(1 << p for p, v in vectors.items() if (v & table).bit_count() & 1) for table in range(1, size + 1)]


def _second_masks(first: list[int], radius: int) -> list[list[int]]:
    """For each first mask: itself together with masks over what it leaves free."""
    return [[m | s for s in covering_masks([p for p in range(64) if not m >> p & 1], radius)] for m in first]


def _hashes(words: list[bytes], size: int) -> list[int]:
    joined, span = b" ".join(words), min(size, len(words))
    digest = xxhash.xxh64_intdigest
    if span == len(words):
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - span].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[span - 1 :] - 1).tolist())]


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of a UTF-8 text as an unsigned 64-bit number."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    hashes = np.array(_hashes(words, size), _U)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNTED):
        part = hashes[start : start + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(id, print): the fingerprint of every row as a signed number."""
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("print", T.LongType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, texts = batch.slice(start, 512).columns
                prints = np.array([fingerprint(t, size) for t in texts.cast(pa.binary()).to_pylist()], _U)
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["id", "print"])
                release()

    return rows.mapInArrow(over, schema)


def _small_buckets(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of what hangs together within small buckets; rows of a bucket follow each other."""
    lab, a, b = np.arange(len(prints)), [], []
    for step in range(1, len(prints)):
        at = np.flatnonzero(bucket[:-step] == bucket[step:])
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
        a.append(near), b.append(near + step)
    if not a or not (one := np.concatenate(a)).size:
        return lab[:0], lab[:0]
    two = np.concatenate(b)
    while True:
        low = np.minimum(lab[one], lab[two])
        before = lab.copy()
        np.minimum.at(lab, one, low), np.minimum.at(lab, two, low)
        lab = lab[lab]
        if (lab == before).all():
            break
    moved = np.flatnonzero(lab != np.arange(len(lab)))
    return moved, lab[moved]


def walked(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, found from) within one bucket: a walk over all pairs within the radius, each member entered once."""
    left, members, origins = np.arange(len(prints)), [], []
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        at = frontier.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
        found = left[near]
        if len(found):
            members.append(found), origins.append(np.full(len(found), at))
            frontier.extend(found.tolist())
            left = left[~near]
    return (np.concatenate(members), np.concatenate(origins)) if members else (left, left)


def _keyed(rows: DataFrame, radius: int, again: bool) -> DataFrame:
    """(least, print, table, part, key): each node once a table; with ``again``, once a second mask of its table."""
    first = covering_masks(list(range(64)), radius)
    masks = [[m] for m in first] if not again else _second_masks(first, radius)
    kind = rows.schema["least"].dataType
    schema = T.StructType([T.StructField("least", kind), *(T.StructField(c, T.LongType()) for c in ("print", "key")), *(T.StructField(c, T.IntegerType()) for c in ("table", "part"))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(_U)
            tables = batch.column(2).to_numpy(zero_copy_only=False) if again else None
            for table, own in enumerate(masks):
                use = np.flatnonzero(tables == table) if again else np.arange(len(prints))
                if not len(use):
                    continue
                picked = batch.take(pa.array(use))
                for part, mask in enumerate(own):
                    n = len(use)
                    yield pa.RecordBatch.from_arrays([
                        picked.column(0), picked.column(1), pa.array((prints[use] & _U(mask)).view(np.int64)),
                        pa.array(np.full(n, table, np.int32)), pa.array(np.full(n, part, np.int32)),
                    ], names=["least", "print", "key", "table", "part"])

    return rows.select("least", "print", *(["table"] if again else [])).mapInArrow(over, schema)


def _compared(keyed: DataFrame, radius: int, crowd: int | None) -> DataFrame:
    """(least, print, root_least, root_print, table): links found in the buckets; ``table`` is set on members of a crowd, which have no root."""
    kind = keyed.schema["least"].dataType
    schema = T.StructType([T.StructField("least", kind), T.StructField("print", T.LongType()), T.StructField("root_least", kind), T.StructField("root_print", T.LongType()), T.StructField("table", T.IntegerType())])
    names = ["least", "print", "root_least", "root_print", "table"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        passing: tuple | None = None  # the crowded bucket whose rows go on unbuffered

        def sent_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            out = rows.select(["least", "print"]).append_column("root_least", pa.nulls(len(rows), rows.schema.field("least").type))
            out = out.append_column("root_print", pa.nulls(len(rows), pa.int64())).append_column("table", rows["table"])
            yield from out.combine_chunks().to_batches()

        def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            prints = rows["print"].to_numpy().view(_U)
            bounds = _bounds(rows)
            sizes = np.diff(bounds)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            some = np.flatnonzero((sizes[bucket] > 1) & (sizes[bucket] <= SMALL))
            member, root = _small_buckets(prints[some], bucket[some], radius)
            ends, origins = [some[member]], [some[root]]
            for k in np.flatnonzero(sizes > SMALL).tolist():
                if crowd and sizes[k] > crowd:
                    yield from sent_on(rows.slice(bounds[k], sizes[k]))
                    continue
                one, two = walked(prints[bounds[k] : bounds[k + 1]], radius)
                ends.append(one + bounds[k]), origins.append(two + bounds[k])
            at, of = pa.array(np.concatenate(ends)), pa.array(np.concatenate(origins))
            if len(at):
                here, there = rows.select(["least", "print"]).take(at).combine_chunks(), rows.select(["least", "print"]).take(of).combine_chunks()
                columns = [here["least"], here["print"], there["least"], there["print"], pa.nulls(len(at), pa.int32())]
                yield from pa.table(dict(zip(names, columns))).combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if passing is not None:
                same = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("table", "part", "key"), passing)])
                n = len(rows) if same.all() else int(np.argmin(same))
                if n:
                    yield from sent_on(rows.slice(0, n))
                if n == len(rows):
                    continue
                rows, passing = rows.slice(n), None
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            last = int(_bounds(rows)[-2])
            if last:
                yield from linked(rows.slice(0, last))
            held = rows.slice(last)
            if crowd and len(held) > crowd:
                yield from sent_on(held)
                passing, held = tuple(held[c][0].as_py() for c in ("table", "part", "key")), None
        if held is not None and len(held):
            yield from linked(held)

    ordered = keyed.repartition(width(keyed.sparkSession), "table", "part", "key").sortWithinPartitions("table", "part", "key")
    return ordered.mapInArrow(over, schema)


def _bounds(rows: pa.Table) -> np.ndarray:
    """Where buckets begin, and the end of the last one."""
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([(c := rows[name].to_numpy())[1:] != c[:-1] for name in ("key", "part", "table")])
    return np.append(np.flatnonzero(new), len(rows))


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): enough links between nodes (least, print), as structs, to tie all pairs within the radius together."""
    found = stored(_compared(_keyed(nodes, radius, again=False), radius, crowd))
    crowded = found.filter("table is not null")
    more = found
    if not crowded.isEmpty():
        more = found.unionByName(_compared(_keyed(crowded, radius, again=True), radius, None))
    return more.filter("root_print is not null").select(F.struct("least", "print").alias("a"), F.struct(F.col("root_least").alias("least"), F.col("root_print").alias("print")).alias("b"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable).

    ``size``: words of a shingle; ``radius``: bits in which linked fingerprints differ at most.
    """
    prints = stored(fingerprints(docs, doc_id, text, size))
    nodes = stored(prints.filter("id is not null").groupBy("print").agg(F.min("id").alias("least")).select("least", "print"))
    found = components(links(nodes, radius, crowd))
    classes = nodes.join(found, F.struct("least", "print") == F.col("node"), "left").select(F.col("print").alias("of"), F.coalesce("component.least", "least").alias("component"))
    own = prints.join(classes, F.col("print") == F.col("of"), "left")
    return own.select(
        F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
