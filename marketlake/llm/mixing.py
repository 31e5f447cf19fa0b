"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the corpus over its actual share, both in code points. Every document is repeated a
Poisson number of times with that mean: the inverse distribution function is read at a number hashed from the seed and the
document's id, so that a document's count depends on nothing else and a rerun repeats it. Copies are then shuffled globally:
they are ordered by a hash of seed, id and copy, over partitions that are equal ranges of the hash.

One small table of the sources is joined: up to ``FEW_SOURCES`` rows are sent to every task, so that a source with a third of
all rows stays spread as it was read; no group is gathered.

Defined cases: null texts and empty texts have no code points; a source without code points keeps its rate at 1; a source that
``weights`` does not name gets none. A null source is a source of its own, a null id is hashed as such. Rows that repeat are
repeated by the same count each, in the same order places. An empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from marketlake.llm.common import stored, text_or_empty, width

__all__ = ["SEED", "mixed", "rates"]

SEED = 17
#: A table of at most so many sources (1.5 KB each at most) is sent to every task; a longer one is joined by shuffling.
FEW_SOURCES = 2_000
#: Rates above this are drawn as sums of several draws, as the first probability would vanish.
LARGEST_RATE = 64.0
#: Copies of a row that are listed at once.
RUN = 1024


def _hashed(seed: int, doc_id: Column, n: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), n.cast("string")).cast("binary"))


def _uniform(seed: int, doc_id: Column, n: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(_hashed(seed, doc_id, n), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n, rate): code points and mean repetition of each source. ``weights``: relative targets; None makes them equal."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.char_length(text_or_empty(text)).cast("long")).alias("n"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
        wanted = sizes.withColumn("weight", named)
    total = wanted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight")).first()
    share = F.lit(float(total["all_n"] or 0)) * F.col("weight") / F.lit(float(total["all_weight"] or 1) or 1.0)
    return wanted.select("source", "n", F.when((F.col("n") > 0) & (F.col("weight") > 0), share / F.col("n")).when(F.col("weight") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("rate"))


def _steps(rate: Column) -> Column:
    """The distribution function's values from 0 up, to where they reach 1 in double precision."""
    first = F.exp(-rate)
    n = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    state = F.aggregate(
        F.sequence(F.lit(1), n), F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("steps")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["total"] + s["p"] * rate / k).alias("total"), F.concat(s["steps"], F.array(s["total"] + s["p"] * rate / k)).alias("steps")),
    )
    return state["steps"]


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", number: bool = True) -> DataFrame:
    """``docs`` with every row repeated by its count, in global random order.

    With ``number``, columns ``copy`` (from 1) and ``shuffle_key`` (the order) are added, replacing columns of these names.
    """
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")
    table = rates(docs, weights, source, text).withColumn("_draws", draws).select(F.col("source").alias("_source"), "_draws", _steps(F.col("rate") / F.col("_draws")).alias("_steps"))
    names = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    own, of = names[doc_id], names[source]
    # the numbers stand in the list that is folded over, so that each is hashed once and not once a step
    numbers = F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), lambda k: _uniform(seed, F.col(own), k))
    drawn = F.aggregate(numbers, F.lit(0), lambda s, u: s + F.size(F.filter("_steps", lambda step: step <= u)))
    table = stored(table)
    if table.count() <= FEW_SOURCES:
        table = F.broadcast(table)
    rows = docs.toDF(*names.values())
    counted = rows.join(table, F.col(of).eqNullSafe(F.col("_source"))).select(*names.values(), drawn.alias("_n")).filter("_n > 0")
    # in two steps: a count of any size makes lists of bounded length
    runs = counted.select(*names.values(), "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / RUN).cast("int"))).alias("_run"))
    first = F.col("_run") * RUN + 1
    copies = runs.select(*names.values(), F.explode(F.sequence(first, F.least(F.col("_n"), first + (RUN - 1)))).alias("_copy"))
    keyed = copies.withColumn("_key", _hashed(seed, F.col(own), F.col("_copy")))
    # keys are uniform: equal ranges of their leading bits need no sample of the rows
    parts = width(docs.sparkSession)
    part = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * parts, 32).cast("int")
    shuffled = keyed.repartitionById(parts, part).sortWithinPartitions("_key")
    if not number:
        return shuffled.select(*names.values()).toDF(*docs.columns)
    rest = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("copy", "shuffle_key")]
    return shuffled.select(*rest, F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"))
