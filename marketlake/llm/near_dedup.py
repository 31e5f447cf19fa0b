"""Near duplicates on word shingles: MinHash bands find candidates, odd sketches screen them, whole sets confirm them.

1. One pass turns every text into its set of shingle hashes, the set's digest, ``BANDS`` band keys of ``ROWS`` MinHash values
   each, and an odd sketch: every MinHash sample flips one bit of a bitmap, so that the XOR of two bitmaps counts the samples
   in which two sets differ.
2. Equal sets collapse into their smallest id, with partial aggregation: a large group of copies is one row from here on.
3. In each band bucket every member is paired with the smallest one only. Pairs whose sketches rule out the threshold go, the
   others are confirmed on whole sets, and components are formed.
4. Where a bucket still holds members of different components, those that were not compared yet are: in blocks, by sketch,
   and only across components, then on whole sets, and components are formed from all links.

A bucket of m near copies so costs m pairs, not m squared, and no cap is set on a bucket. A link at the threshold is missed by
the bands with probability (1 - 0.8^5)^30 = 7e-6; the screen is set six standard deviations below the threshold.

Defined cases: a null text counts as empty; a text without words has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle. A row whose id is null is linked with nothing, its component is null and it is
kept. Rows that repeat an id are one node, with all links of their texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlake.llm.common import release, stored, text_or_empty, width
from marketlake.llm.components import components

__all__ = ["BANDS", "ROWS", "drop_near_copies", "near_copies", "shingle_set", "signatures"]

BANDS, ROWS = 30, 5
#: Words of the odd sketch, 64 bits each.
SKETCH_WORDS = 8
#: Members of a block; two blocks are compared in one step.
BLOCK = 256
#: Bits of the bitmap that tells which texts may be wanted: 1 MB, whatever the input.
MARKS = 1 << 23
#: Word hashes that a task remembers before it starts afresh.
REMEMBERED = 50_000

_U = np.uint64
_PRIME, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, size: int, memory: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of the word shingles of a UTF-8 text, ascending. ``memory`` keeps word hashes between calls."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.empty(0, _U)
    if len(memory) > REMEMBERED:
        memory.clear()
    for w in set(words).difference(memory):
        memory[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(memory.__getitem__, words), _U, len(words))
    n, span = len(words), min(size, len(words))
    out = hashes[: n - span + 1].copy()
    for j in range(1, span):
        out = out * _PRIME + hashes[j : n - span + 1 + j]
    return np.unique(_mixed(out + _U(span)))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _PRIME
    made = _mixed(seeds)
    return made[: BANDS * ROWS] | _U(1), made[BANDS * ROWS :]


def minhashes(elements: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over the elements, in pieces of bounded size."""
    least = np.full(len(factors), np.iinfo(_U).max, _U)
    for start in range(0, len(elements), 2048):
        piece = elements[start : start + 2048]
        np.minimum(least, ((piece[None, :] ^ offsets[:, None]) * factors[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap in which each sample, hashed with its number, flips one bit."""
    at = (_mixed(samples + np.arange(1, len(samples) + 1, dtype=_U) * _MIX2) % _U(64 * SKETCH_WORDS)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(_U)


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, n, hi, lo, bands, sketch): size and digest of the shingle set, band keys, odd sketch; the last four null for an empty set."""
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _constants()
        memory: dict[bytes, int] = {}
        lead = np.arange(1, BANDS + 1, dtype=_U) * _MIX1
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, texts = batch.slice(start, 512).columns
                n, digests, bands, sketches = [], [], [], []
                for plain in texts.cast(pa.binary()).to_pylist():
                    found = shingle_set(plain, size, memory)
                    n.append(len(found))
                    if not len(found):
                        digests.append(None), bands.append(None), sketches.append(None)
                        continue
                    least = minhashes(found, factors, offsets)
                    keys = lead.copy()
                    for column in least.reshape(BANDS, ROWS).T:
                        keys = _mixed(keys * _PRIME + column)
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
                    bands.append(keys.view(np.int64))
                    sketches.append(odd_sketch(least).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(n, pa.int64()), pa.array([None if d is None else int(d[0]) for d in digests], pa.int64()),
                    pa.array([None if d is None else int(d[1]) for d in digests], pa.int64()), pa.array(bands, longs), pa.array(sketches, longs),
                ], names=["id", "n", "hi", "lo", "bands", "sketch"])
                release()

    return rows.mapInArrow(over, schema)


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every wanted id has its bit: what it rules out need not be shuffled."""
    words = wanted.select(_slot().alias("slot")).selectExpr("shiftright(slot, 6) as word", "shiftleft(1L, cast(slot & 63 as int)) as bits")
    out = np.zeros(MARKS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.view(_U)


def _slot() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(MARKS))


def _packed(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, hi, packed): the words of the wanted (id, hi), compressed."""
    marks = _marks(wanted)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).filter("id is not null").withColumn("slot", _slot())
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("hi", T.LongType()), T.StructField("packed", T.BinaryType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                slots = part.column(2).to_numpy().astype(np.int64)
                part = part.filter(pa.array((marks[slots >> 6] >> (slots & 63).astype(_U)) & _U(1) == 1))
                ids, texts, _ = part.columns
                plain = [b" ".join(t.lower().split()) for t in texts.cast(pa.binary()).to_pylist()]
                found = [shingle_set(t, size, memory) for t in plain]
                hi = [int(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes())[:8], np.int64)[0]) if len(x) else None for x in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(hi, pa.int64()), pa.array([pack.compress(t) for t in plain], pa.binary())], names=["id", "hi", "packed"])
                release()

    return rows.mapInArrow(over, schema).join(wanted, ["id", "hi"], "left_semi").dropDuplicates(["id", "hi"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the similarity."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _screen(threshold: float) -> int:
    """The most bits in which the sketches of two sets of this similarity differ, six standard deviations included."""
    k, bits = BANDS * ROWS, 64 * SKETCH_WORDS
    low = threshold - 6 * (threshold * (1 - threshold) / k + (0.25 * bits * (np.exp(8 * k * (1 - threshold) / bits) - 1) - 2 * k * (1 - threshold)) / (4 * k * k)) ** 0.5
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * k * (1 - max(low, 0.0)) / bits))))


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def _confirmed(pairs: DataFrame, packed: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, a_hi, b, b_hi) whose whole sets reach the threshold, as (a, b)."""
    left = packed.select(F.col("id").alias("a"), F.col("hi").alias("a_hi"), F.col("packed").alias("a_packed"))
    right = packed.select(F.col("id").alias("b"), F.col("hi").alias("b_hi"), F.col("packed").alias("b_packed"))
    both = pairs.join(right, ["b", "b_hi"]).join(left, ["a", "a_hi"]).select("a", "b", "a_packed", "b_packed")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, memory = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a, b = ([shingle_set(unpack.decompress(x), size, memory) for x in part.column(i).to_pylist()] for i in (2, 3))
                yield part.select([0, 1]).filter(pa.array([_linked(x, y, percent) for x, y in zip(a, b)], pa.bool_()))
                release()

    return both.mapInArrow(over, both.select("a", "b").schema)


def _across(members: DataFrame, most: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members (bucket, held, id, n, component, sketch, packed) of one bucket and different components.

    Blocks of a bucket are compared pair by pair, each pair in one step. Within a step a link found joins two components, and
    what then hangs together is not compared further: at most one link for each member comes out.
    """
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", "n"), F.col("blocks")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component", "sketch", "packed")
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compared(group: list[tuple], memory: dict[bytes, int]) -> Iterator[tuple]:
        own, n = np.array([g[3] for g in group]), np.array([g[5] for g in group])
        sketch = np.array([g[7] for g in group], np.int64).view(_U)
        unpack, sets, root = zstandard.ZstdDecompressor(), {}, {}

        def whole(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = shingle_set(unpack.decompress(group[r][8]), size, memory)
            return sets[r]

        def top(x: object) -> object:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for r in np.flatnonzero(own == group[0][1]).tolist():
            others = np.flatnonzero(own == group[0][2])
            others = others[others > r] if group[0][1] == group[0][2] else others
            others = others[100 * np.minimum(n[others], n[r]) >= percent * np.maximum(n[others], n[r])]
            for c in others[np.bitwise_count(sketch[others] ^ sketch[r]).sum(axis=1) <= most].tolist():
                here, there = top(group[r][6]), top(group[c][6])
                if here != there and _linked(whole(r), whole(c), percent):
                    root[here] = there
                    yield group[r][4], group[c][4]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        memory: dict[bytes, int] = {}
        for batch in batches:
            kind, out = batch.schema.field("id").type, []
            for start in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    if group and group[0][:3] != row[:3]:
                        out += compared(group, memory)
                        group.clear()
                    group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out)], names=["a", "b"])
        if group and (out := list(compared(group, memory))):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out)], names=["a", "b"])

    placed_rows = dealt.repartition(width(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed_rows.mapInArrow(over, schema).distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable), kept, n_links.

    ``size``: words of a shingle; ``percent``: the Jaccard similarity from which two texts are linked, in hundredths.
    ``n_links`` counts the confirmed links of the row's set with other sets; links inside a component that already hang
    together are not all looked for.
    """
    most = _screen(percent / 100)
    rows = stored(signatures(docs, doc_id, text, size))
    named = rows.filter("hi is not null and id is not null")
    sets_of = stored(named.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    # step 3: each member of a bucket against the smallest
    placed = sets_of.select("id", "hi", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("held"), F.min(F.struct("id", "hi")).alias("centre")).filter("held > 1")
    members = stored(placed.join(buckets, "bucket").select("bucket", "held", "id", "hi", F.col("centre.id").alias("a"), F.col("centre.hi").alias("a_hi")))
    light = sets_of.select("id", "hi", "n", "sketch")

    def facts(side: str) -> DataFrame:
        return light.select(F.col("id").alias(side), F.col("hi").alias(f"{side}_hi"), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))

    stars = members.select("a", "a_hi", F.col("id").alias("b"), F.col("hi").alias("b_hi")).filter("a != b or a_hi != b_hi").distinct()
    near = stars.join(facts("b"), ["b", "b_hi"]).join(facts("a"), ["a", "a_hi"])
    alike = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (_differing("a_sketch", "b_sketch") <= most)
    pairs = stored(near.filter(alike).select("a", "a_hi", "b", "b_hi"))
    packed = stored(_packed(docs, _ends(pairs), doc_id, text, size))
    links = stored(_confirmed(pairs, packed, size, percent))

    # ids that come with several sets tie all of these to the smallest
    firsts = named.select("id", "hi", "lo").join(sets_of.select("hi", "lo", F.col("id").alias("first")), ["hi", "lo"]).select("id", "first").distinct()
    several = firsts.groupBy("id").agg(F.min("first").alias("least"), F.count("*").alias("k")).filter("k > 1").select("id", "least")
    among = firsts.join(several, "id").select(F.col("first").alias("a"), F.col("least").alias("b"))
    tied = stored(among.union(several.select("id", "least")).filter("a != b").distinct())
    found = components(links.union(tied))

    # step 4: what a bucket still holds apart; of buckets with the same members one is enough
    apart = members.filter("held > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = apart.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("id", "hi").cast("decimal(38,0)")).alias("whose")
    ).filter("low < high").groupBy("m", "whose").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = stored(apart.join(split, "bucket").select("bucket", "held", "id", "hi", "component"))
    if left.limit(1).count():
        wanted = left.select("id", "hi").distinct()
        missing = stored(wanted.join(packed.select("id", "hi"), ["id", "hi"], "left_anti"))
        extra = stored(_packed(docs, missing, doc_id, text, size))
        full = left.join(light, ["id", "hi"]).join(packed.union(extra), ["id", "hi"]).select("bucket", "held", "id", "n", "component", "sketch", "packed")
        links = stored(links.union(_across(full, most, size, percent)).distinct())
        found = components(links.union(tied))

    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links"))
    classes = sets_of.select("hi", "lo", "id").join(found, F.col("id") == F.col("node"), "left").join(degree, F.col("id") == F.col("a"), "left")
    classes = classes.select("hi", "lo", F.coalesce("component", "id").alias("component"), "n_links")
    out = rows.select("id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id"), F.col("a_hi").alias("hi")).union(pairs.select("b", "b_hi")).distinct()


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but the smallest id of each component, with all its columns; rows without an id stay."""
    gone = near_copies(docs, doc_id, text, size, percent).filter("not kept").select(F.col(doc_id).alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_own"))
    return rows.join(gone, F.col("_own") == F.col("_gone"), "left_anti").select("_row.*")
