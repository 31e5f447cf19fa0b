"""Cooldown de-duplication: keep a notice, suppress its repeats for a while.

A notice is retained when at least ``cooldown`` has passed since the last *retained* one
with the same key; repeats in between are suppressed and counted, and the count is
delivered with the next retained notice. The anchor moves with every retained notice, so
this is a chain and not a gap-based session.

The chain is found without walking it. Let an instant's predecessor be the last instant at
least one cooldown before it, and its rank the number of predecessors one after the other.
The i-th retained instant is the first one of rank i: an instant is at or after it exactly
when its predecessor is at or after the one before. So ranks are all that is needed, and
pointer doubling gives them in as many rounds as the longest chain's length has bits: each
round replaces every pointer by its target's pointer and adds the ranks up.

Only instants that precede others take part in the rounds, spread by key and time; a burst
of any number of instants within one cooldown is one target. Every second round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from marketlake.session import cut_lineage

__all__ = ["after_anchors", "retained_notices"]

BLOCK_COOLDOWNS = 64  # stretch of a key's time that one task searches for predecessors, in cooldowns


def _moments(notices: DataFrame, key: str) -> DataFrame:
    """One row per key and instant: how many notices, the smallest id; reduced on the map side."""
    return notices.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).groupBy(F.col(key).alias("key"), F.unix_micros("ts").alias("t")).agg(
        F.count("*").alias("n"), F.min("event_id").alias("event_id")
    )


def _with_predecessor(moments: DataFrame, cooldown: int, width: int) -> DataFrame:
    """Adds ``before``: the last instant of the key at least one cooldown earlier, null for none.

    Instants and questions (at t - cooldown) are stacked and dealt by key and block of time.
    A question that its block cannot answer takes the last instant of the blocks before.
    """
    asked = F.array(
        F.struct(F.col("t").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("t") - cooldown).alias("at"), F.lit(1).alias("kind")),
    )
    stacked = moments.select("key", "t", "n", "event_id", F.explode(asked).alias("x")).select("key", "t", "n", "event_id", "x.*")
    stacked = stacked.withColumn("block", F.floor(F.col("at") / width).cast("bigint"))
    instant = F.when(F.col("kind") == 0, F.col("at"))
    own = F.last(instant, ignorenulls=True).over(W.partitionBy("key", "block").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    here = stacked.withColumn("before", own).where("kind = 1")
    ends = stacked.groupBy("key", "block").agg(F.max(instant).alias("end"))
    earlier = F.last("end", ignorenulls=True).over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    joined = here.join(ends.select("key", "block", earlier.alias("_end")), ["key", "block"])
    return joined.select("key", "t", "n", "event_id", F.coalesce("before", "_end").alias("before"))


def _doubled(state: DataFrame) -> DataFrame:
    """Every pointer replaced by its target's pointer, the ranks added up."""
    target = state.select("key", F.col("t").alias("to"), F.col("to").alias("_next"), F.col("rank").alias("_more"))
    moved = state.join(target, ["key", "to"], "left")
    return moved.select("key", "t", F.col("_next").alias("to"), (F.col("rank") + F.coalesce("_more", F.lit(0))).alias("rank"))


def _ranks(pointers: DataFrame) -> DataFrame:
    """(key, t, rank): how many pointers lead from each instant to one without; ``pointers``: key, t, before.

    Pointer doubling, twice between two written tables; null pointers end it.
    """
    state = cut_lineage(pointers.select("key", "t", F.col("before").alias("to"), F.col("before").isNotNull().cast("bigint").alias("rank")))
    while not state.where("to is not null").isEmpty():
        state = cut_lineage(_doubled(_doubled(state)))
    return state.select("key", "t", "rank")


def retained_notices(notices: DataFrame, cooldown_seconds: float, key: str = "dedup_key") -> DataFrame:
    """Retained notices: (key, ts, event_id, delivered_suppressed, suppressed_after).

    ``notices`` has the key, ``ts`` and ``event_id``; of several events at one instant the
    smallest id is the one retained; notices without a key or an instant are left out.
    ``delivered_suppressed`` counts the repeats since the
    previous retained notice, ``suppressed_after`` those since this one.
    """
    cooldown = int(cooldown_seconds * 1_000_000)
    if cooldown <= 0:
        raise ValueError("cooldown must be positive")
    moments = cut_lineage(_moments(notices, key))
    linked = cut_lineage(_with_predecessor(moments, cooldown, cooldown * BLOCK_COOLDOWNS))
    aims = linked.where("before is not null").select("key", F.col("before").alias("t")).distinct()
    ranks = _ranks(linked.join(aims, ["key", "t"], "left_semi").select("key", "t", "before"))
    ranked = linked.join(ranks.select("key", F.col("t").alias("before"), "rank"), ["key", "before"], "left")
    ranked = ranked.withColumn("rank", F.coalesce(F.col("rank") + 1, F.lit(0)))

    first = F.min(F.struct("t", "event_id")).alias("first")
    groups = ranked.groupBy("key", "rank").agg(first, (F.sum("n") - 1).alias("suppressed"))
    # each group tells the next one what it suppressed
    told = F.array(
        F.struct(F.col("rank"), F.col("first"), F.col("suppressed"), F.lit(None).cast("bigint").alias("earlier")),
        F.struct((F.col("rank") + 1).alias("rank"), F.lit(None).cast(groups.schema["first"].dataType).alias("first"), F.lit(None).cast("bigint").alias("suppressed"), F.col("suppressed").alias("earlier")),
    )
    met = groups.select("key", F.explode(told).alias("x")).select("key", "x.*").groupBy("key", "rank").agg(
        F.max("first").alias("first"), F.max("suppressed").alias("suppressed_after"), F.max("earlier").alias("earlier")
    )
    return met.where("first is not null").select(
        F.col("key").alias(key), F.timestamp_micros("first.t").alias("ts"), "first.event_id",
        F.coalesce("earlier", F.lit(0)).alias("delivered_suppressed"), "suppressed_after",
    )


def after_anchors(notices: DataFrame, anchors: DataFrame, cooldown_seconds: float, key: str = "dedup_key") -> tuple[DataFrame, DataFrame]:
    """One more batch of a chain: (retained notices, new anchors).

    ``anchors``: key, ``anchor`` (instant of the last retained notice), ``pending`` (repeats suppressed since). Notices less
    than a cooldown after their key's anchor, or before it, are suppressed and counted; the chain goes on with the others.
    Retained notices carry ``delivered_suppressed`` as in :func:`retained_notices`.
    """
    cooldown = int(cooldown_seconds * 1_000_000)
    rows = notices.join(anchors.select(F.col(key), F.unix_micros("anchor").alias("_anchor")), key, "left")
    free = F.col("_anchor").isNull() | (F.unix_micros("ts") >= F.col("_anchor") + cooldown)
    rows = rows.withColumn("_free", free)
    held = rows.where("not _free").groupBy(key).agg(F.count("*").alias("_held"))
    pending = anchors.join(held, key, "left").select(key, "anchor", (F.col("pending") + F.coalesce("_held", F.lit(0))).alias("pending"))
    found = cut_lineage(retained_notices(rows.where("_free").select(key, "ts", "event_id"), cooldown_seconds, key))
    opening = found.groupBy(key).agg(F.min("ts").alias("ts"), F.max_by(F.struct("ts", "suppressed_after"), "ts").alias("last"))
    retained = found.join(opening.select(key, "ts", F.lit(True).alias("_first")), [key, "ts"], "left").join(pending.select(key, "pending"), key, "left")
    retained = retained.select(
        key, "ts", "event_id", F.when(F.col("_first"), F.coalesce("pending", F.lit(0))).otherwise(F.col("delivered_suppressed")).alias("delivered_suppressed")
    )
    now = pending.join(opening.select(key, "last"), key, "full").select(
        key, F.coalesce("last.ts", "anchor").alias("anchor"), F.coalesce("last.suppressed_after", "pending").alias("pending")
    )
    return retained, now
