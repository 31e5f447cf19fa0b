"""Secrets, and who owns them: a credential that many repositories and owners share is an example, one owner's is live-looking.

Three fixed patterns find assignments, access keys and long hexadecimal runs. A wider pattern adds strings that look random.
Every candidate's hash is counted over the whole table by distinct repositories and owners, with partial sums before the
shuffle. A wide candidate is reported where a single owner has it; each fixed finding is told live or copied by the same count.

Only hashes of candidates are shuffled, never texts. A table of the rows' findings is written to the shared folder once.

Defined cases: null and empty texts have no findings. A null owner or repository is one of its own. Rows that repeat are
reported each and count once per repository and owner. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlake.llm.common import clear_of, stored, text_or_empty

__all__ = ["KINDS", "base_spans", "find_secrets", "wide_spans"]

#: Fixed kinds in the order that breaks ties of starts, then the kind that ownership adds.
KINDS = ("assign", "access", "hex", "owned")

# Fixed patterns. Keyword letters in either case, ASCII only.
_WORDS = "password passwd secret token".split()
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in _WORDS) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates beyond the fixed kinds: long unbroken runs, kept if they mix digits and letters evenly enough.
WIDE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a wide candidate holds at least, by the frequencies of its own characters.
LEAST_BITS = 3.2


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, secret) of the fixed kinds, by start, then kind."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def wide_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, secret) of random-looking runs that overlap no fixed finding."""
    found, clear = [], clear_of([(s, e) for s, e, *_ in taken])
    for m in WIDE.finditer(text):
        run = m[0]
        digits = sum(c.isdigit() for c in run)
        if digits < 3 or sum(c.isalpha() for c in run) < 3:
            continue
        if -sum(k / len(run) * math.log2(k / len(run)) for k in Counter(run).values()) < LEAST_BITS:
            continue
        if clear(m.start(), m.end()):
            found.append((m.start(), m.end(), run))
    return found


def _findings(docs: DataFrame, doc_id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """One row per row of ``docs``: id, repository, owner, found (start, end, kind, hash of the secret)."""
    rows = docs.select(F.col(doc_id).alias("id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text_or_empty(text).alias("text"))
    item = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("hash", T.LongType())]))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("found", item)])
    made = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64())]))

    def hashed(secret: str) -> int:
        return (xxhash.xxh3_64_intdigest(secret.encode()) ^ (1 << 63)) - (1 << 63)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for plain in part.column(3).to_pylist():
                    base = base_spans(plain)
                    wide = [(s, e, 3, x) for s, e, x in wide_spans(plain, base)]
                    out.append([{"start": s, "end": e, "kind": k, "hash": hashed(x)} for s, e, k, x in base + wide])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, made)], names=["id", "repository", "owner", "found"])

    return rows.mapInArrow(over, schema)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by fixed kind, digests and texts of the spans, and n_live, n_copied.

    ``repository`` and ``owner`` default to source and language together, and to the source.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    rows = stored(_findings(docs, doc_id, text, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "repository", "owner", F.explode("found").alias("s")).select("row", "repository", "owner", "s.*")
    held = each.select("hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repository"), F.lit("")).alias("repository")).distinct()
    spread = held.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    told = each.join(spread, "hash").groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == 3) & (F.col("owners") == 1), F.struct("start", "kind", "end"))).alias("added"),
        F.count(F.when((F.col("owners") == 1), 1)).alias("n_live"), F.count(F.when(F.col("owners") > 1, 1)).alias("n_copied"), F.max("repositories").alias("most_repositories"),
    )
    base = F.filter("found", lambda s: s["kind"] < 3)
    shown = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = rows.join(told, "row", "left")
    every = F.array_sort(F.concat(shown, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))

    def counted(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return out.select(
        F.col("id").alias(doc_id), *map(counted, range(3)), F.sha2(_joined(shown).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )
