"""Document fingerprints by I-Match, and how well they survive an edit.

Terms are the words of a text, A-Z as a-z. Only terms whose document frequency lies in a band count: at least ``LEAST_DF``
documents, at most the share ``MOST_SHARE`` of all (so in a band of inverse document frequency). A term above that share stays
when copies alone bring it there: at least half of its documents repeat texts, and of the distinct texts at most the share has
it. A lexicon is a random subset
of the terms, chosen by their hash; of each lexicon's terms that a text has, sorted and distinct, a hash is kept. ``LEXICONS``
lexicons at each of several sampling levels: level m holds one in ``LEXICONS * 2**m`` terms a lexicon, each level within the one
before it. A text's fingerprint starts at the level at which its lexicons hold one or two of its terms each, whatever its
length, and goes ``DEPTH`` levels further, so that texts of different lengths meet at a common level. A text that has terms in the
band and none of them in a lexicon at that level starts lower, at a level that fits its own terms in the band: what follows a
text has no part in its fingerprint, and its edited form is printed for itself.

The likeness of two fingerprints is the share of lexicons, at the finest level that both have, on which they agree, among
those of which either has a term; 0 where there is none.

Every text's edited form takes the head of the next document, so documents are dealt by ranges of the id, sorted, and read in
a stream that holds two texts; each range also gets the first document of the next. A bitmap of fixed size tells there which
terms may be in the band; only such terms go on, and more of them where a text has few. Texts travel once, compressed; they would
once more only for texts whose sample the bitmap mistook for terms of the band, which takes a band of many times its bits.

Defined cases: a null text counts as empty; a text without terms in the band has an empty fingerprint and likeness 0 to all.
Ids that are null come first; of equal ids the order is that of the texts' digests; rows that repeat follow each other. A
single document is its own next one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import stored_alone, text_or_empty, width

__all__ = ["LEXICONS", "edited", "fingerprints", "frequencies", "likeness"]

LEXICONS = 16
#: Levels of a fingerprint beyond its first.
DEPTH = 3
#: The band: documents that have a term at least, and the share of documents at most.
LEAST_DF, MOST_SHARE = 2, 0.1
#: Term hashes that a task remembers before it starts afresh.
REMEMBERED = 300_000

_BITS = int(math.log2(LEXICONS))
#: What parts words.
_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")
#: Bits of the bitmaps of texts that go to every task (1 MB), and of the bitmap of the band's terms (8 MB).
_SLOTS, _BAND_SLOTS = 1 << 23, 1 << 26
#: Terms of a text's first sample that may be in the band from which no others are looked for.
SURE = 8


def _words(text: bytes) -> set[bytes]:
    return set(text.lower().split())


def _hashes(words: list[bytes], memory: dict[bytes, int]) -> np.ndarray:
    if len(memory) > REMEMBERED:
        memory.clear()
    for w in words:
        if w not in memory:
            memory[w] = (xxhash.xxh3_64_intdigest(w) ^ (1 << 63)) - (1 << 63)
    return np.fromiter(map(memory.__getitem__, words), np.int64, len(words))


def _terms(text: bytes, memory: dict[bytes, int]) -> np.ndarray:
    """The distinct term hashes of a UTF-8 text."""
    return _hashes(list(_words(text)), memory)


def _both_terms(text: bytes, changed: bytes, same: int, memory: dict[bytes, int]) -> tuple[np.ndarray, int, int]:
    """Term hashes of a text and its edited form, which agree in the first ``same`` bytes: those up to an end are the text's,
    those from a start on the edited form's; what both have before the edit is read once."""
    cut = 1 + max(text.rfind(blank, 0, same) for blank in _BLANKS)
    shared = _words(text[:cut])
    own, new = _words(text[cut:]) - shared, _words(changed[cut:]) - shared
    return _hashes([*own, *shared, *new], memory), len(own) + len(shared), len(own)


def _level(terms: int) -> int:
    """The level at which each lexicon holds one or two of so many terms."""
    return max(0, int(math.log2(max(1, terms) / LEXICONS)))


def _sampled(hashes: np.ndarray, level: int) -> np.ndarray:
    """The hashes that are in a lexicon at this level: the bits above the lexicon's own are zero."""
    return hashes[(hashes >> _BITS) & ((1 << level) - 1) == 0]


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): hashes of all terms and the documents that have them; counted per batch before the shuffle."""
    rows = docs.select(text_or_empty(text).alias("text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                found = [_terms(t, memory) for t in batch.slice(start, 1024).column(0).cast(pa.binary()).to_pylist()]
                terms, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts.astype(np.int64))], names=["term", "n"])

    return rows.mapInArrow(over, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _slot(low: int) -> int:
    return low & (_SLOTS - 1)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """Bits of the slots (column ``slot``), in a fixed size whatever the input."""
    out = np.zeros(_SLOTS // 8, np.uint8)
    words = slots.selectExpr("shiftright(slot, 3) as word", "shiftleft(1, cast(slot & 7 as int)) as bits")
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _band_slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> 37) & (_BAND_SLOTS - 1)


def _band_bitmap(band: DataFrame) -> np.ndarray:
    """Bits of the terms in the band, in 64-bit words: a fixed size whatever the input."""
    slot = F.shiftright("term", 37).bitwiseAND(_BAND_SLOTS - 1)
    words = band.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) as word", "shiftleft(1L, cast(slot & 63 as int)) as bits").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_BAND_SLOTS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _known(terms: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which terms may be in the band: all that are, and few others."""
    slots = _band_slots(terms)
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def _chosen(known: np.ndarray, level: int) -> np.ndarray:
    """The sample at a level; with few in it, also the sample at the level that fits the terms that may be in the band."""
    first = _sampled(known, level)
    return first if len(first) >= SURE else np.union1d(first, _sampled(known, min(level, _level(len(known)))))


def _by_copies(docs: DataFrame, text: str, frequent: dict[int, int], total: int) -> list[int]:
    """Those of the frequent terms that copies alone make frequent."""
    rows = docs.select(text_or_empty(text).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                found: dict[bytes, int] = {}
                for plain in batch.slice(start, 1024).column(0).cast(pa.binary()).to_pylist():
                    digest = xxhash.xxh3_128_digest(plain)
                    found[digest] = found.get(digest, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["digest", "n"])

    repeated = stored_alone(rows.mapInArrow(digests, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1"))
    more = repeated.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    # a term above the share that half of its documents repeat has that many repeats
    if 2 * more < MOST_SHARE * total:
        return []
    bits = _bitmap(repeated.select((F.conv(F.hex(F.substring("digest", 9, 8)), 16, -10).cast("long").bitwiseAND(_SLOTS - 1)).alias("slot")))
    known = np.array(list(frequent), np.int64)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = {}, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                keys, values = [], []
                for plain in batch.slice(start, 1024).column(0).cast(pa.binary()).to_pylist():
                    digest = xxhash.xxh3_128_digest(plain)
                    slot = _slot(int.from_bytes(digest[8:], "big"))
                    if bits[slot >> 3] >> (slot & 7) & 1 and digest not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        keys.append(digest)
                        values.append(np.intersect1d(_terms(plain, memory), known))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))], names=["digest", "terms"])

    texts = rows.mapInArrow(terms, "digest binary, terms array<long>").groupBy("digest").agg(F.first("terms").alias("terms")).join(repeated, "digest")
    extra = {r["term"]: r["n"] for r in texts.select(F.explode("terms").alias("term"), (F.col("n") - 1).alias("n")).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    most = max(LEAST_DF, MOST_SHARE * (total - more))
    return [t for t, n in extra.items() if frequent[t] - n <= most and 2 * n >= frequent[t]]


def _band(docs: DataFrame, text: str, total: int) -> DataFrame:
    """(term): the terms in the band."""
    counted = stored_alone(frequencies(docs, text).filter(F.col("df") >= LEAST_DF))
    most = max(LEAST_DF, MOST_SHARE * total)
    # bounded by the mean number of a text's terms over the share
    frequent = {r["term"]: r["df"] for r in counted.filter(F.col("df") > most).collect()}
    kept = _by_copies(docs, text, frequent, total) if frequent else []
    return counted.filter((F.col("df") <= most) | F.col("term").isin(kept)).select("term")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many from the start of the following text, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame, doc_id: str, parts: int) -> tuple[list, list, list]:
    """Bounds that cut the ids into about equal ranges; the ranges in use and the smallest id of each."""
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    part = F.coalesce(sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0)) if len(cuts) < 64 else F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id"))), F.lit(0))
    first = ids.select(part.alias("part"), "id").groupBy("part").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("nameless")).orderBy("part").collect()
    return cuts, [r["part"] for r in first], [None if r["nameless"] else r["least"] for r in first]


def _streamed(docs: DataFrame, doc_id: str, text: str, ranges: tuple[list, list, list], bits: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(row, term, here, there, id, n, sha, next): a row per sampled term of a text or its edited form, and one with the text's facts.

    ``row`` numbers the texts in id order, ``next`` is the following text's number, ``la`` and ``lb`` where the samples start,
    ``ma`` and ``mb`` where those start that are sampled lower, ``all_a`` and ``all_b`` whether no term that may be in the band is left out.
    With a bitmap of wanted rows: all such terms of these, and nothing of others.
    """
    parts = width(docs.sparkSession)
    cuts, used, firsts = ranges
    order = {p: i for i, p in enumerate(used)}
    before = {first: used[i - 1] for i, first in enumerate(firsts)}  # the range that also needs a range's first document
    bounds = np.array(cuts, np.int64)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, plain in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    own, tie, small = (0 if i is None else int(np.searchsorted(bounds, i, "left"))), xxhash.xxh3_64_intdigest(plain) >> 1, pack.compress(plain)
                    for halo, at in ((0, own), (1, before.get(i))):
                        if at is not None:
                            for column, x in zip(out, (at, halo, i, tie, small)):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "halo", "id", "tie", "small"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, memory = zstandard.ZstdDecompressor(), {}
        held: tuple | None = None
        k = 0
        facts: list[tuple] = []
        sampled: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def put(one: tuple, following: str, number: int, after: int) -> None:
            slot = _slot(xxhash.xxh3_64_intdigest(number.to_bytes(8, "big")))
            if wanted is not None and not wanted[slot >> 3] >> (slot & 7) & 1:
                return
            nonlocal waiting
            plain = one[2].decode("utf-8", "surrogatepass")
            changed = edited(plain, following)
            same = len(plain[: len(plain) - len(plain) // 4].encode("utf-8", "surrogatepass"))
            changed_bytes = changed.encode("utf-8", "surrogatepass")
            found, end, start = _both_terms(one[2], changed_bytes, same, memory)
            la, lb = _level(end), _level(len(found) - start)
            known = _known(found, bits)
            ka, kb = found[:end][known[:end]], found[start:][known[start:]]
            sa, sb = (_chosen(ka, la), _chosen(kb, lb)) if wanted is None else (ka, kb)
            terms = np.union1d(sa, sb)
            digest = hashlib.sha256(changed_bytes).hexdigest()
            facts.append((number, ((number ^ 0x5DEECE66D) * 0x9E3779B97F4A7C15) % (1 << 62), True, True, one[1], len(plain), digest, la, lb, after, min(la, _level(len(ka))), min(lb, _level(len(kb))), len(sa) == len(ka), len(sb) == len(kb)))
            sampled.append((number, terms, np.isin(terms, sa), np.isin(terms, sb)))
            waiting += 1 + len(terms)

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            names = ["row", "term", "here", "there", "id", "n", "sha", "la", "lb", "next", "ma", "mb", "all_a", "all_b"]
            types = pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*facts), types)], names=names)
            numbers, terms, here, there = zip(*sampled)
            columns = np.repeat(np.array(numbers, np.int64), [len(t) for t in terms]), np.concatenate(terms), np.concatenate(here), np.concatenate(there)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(len(columns[0]), t) for t in types[4:])], names=names)
            facts.clear()
            sampled.clear()
            waiting = 0

        for batch in batches:
            for part, halo, i, small in zip(*(batch.column(name).to_pylist() for name in ("part", "halo", "id", "small"))):
                if held is not None and held[0] != part:
                    held, k = None, 0  # the range before is closed by its halo
                if held is not None and held[3]:
                    continue  # further documents with the first one's id
                plain = unpack.decompress(small)
                if held is not None:
                    follower = ((order[part] + 1) % len(order)) << 40 if halo else (order[part] << 40) + k + 1
                    put(held, plain.decode("utf-8", "surrogatepass"), (order[part] << 40) + k, follower)
                    k += 1
                held = part, i, plain, halo
                if waiting > 20_000:
                    yield from flushed()
        if facts:
            yield from flushed()

    spread = rows.mapInArrow(dealt, "part int, halo int, id long, tie long, small binary").repartitionById(parts, F.col("part"))
    # the halo of a range sorts behind its own documents
    ranged = spread.sortWithinPartitions("part", "halo", F.col("id").asc_nulls_first(), "tie")
    return ranged.mapInArrow(streamed, "row long, term long, here boolean, there boolean, id long, n long, sha string, la int, lb int, next long, ma int, mb int, all_a boolean, all_b boolean")


def _print(hashes: np.ndarray, level: int, last: int | None = None) -> str:
    """Level by level the lexicons' hashes: ``level:h,h,...`` joined by semicolons; a lexicon without terms leaves its place empty."""
    if not len(hashes):
        return ""
    out = []
    found = np.sort(hashes)
    for at in range(level, (level if last is None else last) + DEPTH + 1):
        found = _sampled(found, at)
        own = found & (LEXICONS - 1)
        by = np.argsort(own, kind="stable")
        packed, bounds = found[by].tobytes(), (8 * np.searchsorted(own[by], np.arange(LEXICONS + 1))).tolist()
        out.append(f"{at}:" + ",".join(xxhash.xxh3_64_hexdigest(packed[a:b])[:8] if a < b else "" for a, b in zip(bounds, bounds[1:])))
    return ";".join(out)


def likeness(a: str, b: str) -> float:
    """The share of lexicons on which two fingerprints agree at the finest level that both have."""
    first, second = (dict(x.split(":") for x in p.split(";")) if p else {} for p in (a, b))
    common = sorted(first.keys() & second.keys(), key=int)
    if not common:
        return 0.0
    pairs = [(x, y) for x, y in zip(first[common[0]].split(","), second[common[0]].split(",")) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    total = docs.count()
    if not total:
        return docs.select(F.col(doc_id), *(F.lit(None).cast(t).alias(c) for c, t in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))))
    band = stored_alone(_band(docs, text, total))
    bits, ranges = _band_bitmap(band), _ranges(docs, doc_id, width(docs.sparkSession))
    band = band.withColumn("known", F.lit(True))

    def told(found: np.ndarray, level: int, low: int) -> str:
        """From the first level if a lexicon has a term there, else from the highest lower one at which one has."""
        if len(own := _sampled(found, level)):
            return _print(own, level)
        while low and not len(_sampled(found, low)):
            low -= 1
        return _print(found, low, level)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, near, lacking, slots = [], [], [], [], []
            for row, x, y, la, lb, ma, mb, all_a, all_b in zip(*(batch[c].to_pylist() for c in ("row", "a", "b", "la", "lb", "ma", "mb", "all_a", "all_b"))):
                a.append(told(np.array(x, np.int64), la, ma))
                b.append(told(np.array(y, np.int64), lb, mb))
                near.append(likeness(a[-1], b[-1]))
                lacking.append(not (x or all_a) or not (y or all_b))
                slots.append(_slot(xxhash.xxh3_64_intdigest(row.to_bytes(8, "big"))))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("row", "next", "id", "n", "sha")), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(near, pa.float64()), pa.array(lacking, pa.bool_()), pa.array(slots, pa.int64())],
                names=["row", "next", "id", "n", "sha", "fingerprint", "edited_fingerprint", "near_edited", "lacks", "slot"],
            )

    def printed(wanted: np.ndarray | None = None) -> DataFrame:
        # written, so that the texts' shuffle is gone before the terms are dealt
        sampled = stored_alone(_streamed(docs, doc_id, text, ranges, bits, wanted))
        found = sampled.join(band, "term", "left").filter("known or n is not null")
        facts = [F.max(c).alias(c) for c in ("id", "n", "sha", "la", "lb", "next", "ma", "mb", "all_a", "all_b")]
        kept = found.groupBy("row").agg(*facts, F.collect_list(F.when(F.col("n").isNull() & F.col("here"), F.col("term"))).alias("a"), F.collect_list(F.when(F.col("n").isNull() & F.col("there"), F.col("term"))).alias("b"))
        return stored_alone(kept.mapInArrow(over, "row long, next long, id long, n long, sha string, fingerprint string, edited_fingerprint string, near_edited double, lacks boolean, slot long"))

    made = printed()
    lacking = made.filter("lacks").select("slot")
    if not lacking.isEmpty():
        lower = printed(_bitmap(lacking))
        again = lower.join(made.filter("lacks").select("row"), "row", "left_semi")
        made = made.filter("not lacks").unionByName(again)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(x, y) for x, y in zip(batch["fingerprint"].to_pylist(), batch["other"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "n", "sha", "fingerprint", "edited_fingerprint", "near_edited")), pa.array(near, pa.float64())], names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    after = made.select(F.col("row").alias("next"), F.col("fingerprint").alias("other"))
    return made.join(after, "next").mapInArrow(compared, f"`{doc_id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
