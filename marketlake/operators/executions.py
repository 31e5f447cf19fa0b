"""Execution log: status application, parent rollup, digests and notices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from marketlake.functions.keyed import first_n
from marketlake.functions.text import blank_to_null

__all__ = [
    "UUID_PATTERN", "apply_statuses", "changed_signals", "enriched", "execution_notices", "rejected_statuses", "rollup", "signal_digest",
    "transition_failure_notices",
]

# Execution states and limits of a digest.
STATUSES = ["PENDING", "RUNNING", "SUCCESS", "FAILED", "ERROR"]
TERMINAL = ["SUCCESS", "FAILED", "ERROR"]
DIGEST_ITEMS = 20
UUID_PATTERN = r"(?i)^[0-9a-f]{1,8}(-[0-9a-f]{1,4}){3}-[0-9a-f]{1,12}$"
_NUMERIC_META = ("recordsProcessed", "recordsInserted")
# Metadata keys that a message's own fields are stored under.
_ENRICHED = {
    "symbolKey": "symbol_key", "jobDefinitionId": "job_definition_id", "executionId": "execution_id",
    "parentExecutionId": "parent_execution_id", "durationMs": "duration_ms", "recordsProcessed": "records_processed",
}


def _is_terminal(c: Column) -> Column:
    return F.coalesce(c.isin(TERMINAL), F.lit(False))


def _reason(id_pattern: str | None, has_meta: bool, has_parent: bool) -> Column:
    """Why a status message is rejected; null when it is well formed."""
    def bad_id(c: Column) -> Column:
        return ~c.rlike(id_pattern) if id_pattern else F.lit(False)

    identity = blank_to_null(F.col("execution_id"))
    known = F.upper(blank_to_null(F.col("status"))).isin(STATUSES)
    out = F.when(identity.isNull() | bad_id(identity), "INVALID_EXECUTION_ID").when(
        ~F.coalesce(known, F.lit(False)), "INVALID_STATUS"
    )
    if has_meta:
        odd = F.lit(False)
        for key in _NUMERIC_META:
            text = blank_to_null(F.col("meta")[key])
            whole = text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("int").isNotNull()
            odd = odd | (text.isNotNull() & ~whole)
        out = out.when(F.coalesce(odd, F.lit(False)), "INVALID_NUMERIC_METADATA")
    if has_parent:
        parent = blank_to_null(F.col("parent_execution_id"))
        out = out.when(parent.isNotNull() & bad_id(parent), "INVALID_PARENT_EXECUTION_ID")
    return out


def _checked(messages: DataFrame, id_pattern: str | None) -> DataFrame:
    return messages.withColumn(
        "reason", _reason(id_pattern, "meta" in messages.columns, "parent_execution_id" in messages.columns)
    )


def rejected_statuses(messages: DataFrame, executions: DataFrame, id_pattern: str | None = UUID_PATTERN) -> DataFrame:
    """Messages that change nothing because they are malformed or name an unknown execution."""
    checked = _checked(messages, id_pattern)
    unknown = checked.where("reason is null").join(
        executions.select(F.col("id").alias("execution_id")), "execution_id", "left_anti"
    ).withColumn("reason", F.lit("UNKNOWN_EXECUTION"))
    return checked.where("reason is not null").unionByName(unknown.select(*checked.columns))


def apply_statuses(messages: DataFrame, executions: DataFrame, id_pattern: str | None = UUID_PATTERN) -> DataFrame:
    """Executions after their messages in arrival order (``seq``).

    The first terminal status wins and closes the execution, ERROR is stored as FAILED.
    So the message that decides is the first terminal one, or the last one if none is
    terminal: two min/max picks, reduced on the map side however many messages one
    execution has. Metadata of all messages up to that one is merged, later keys win.
    """
    extra = [c for c in ("error", "started_at", "finished_at", "records_synced", "new_offset") if c in messages.columns]
    valid = _checked(messages, id_pattern).where("reason is null")
    status = F.when(F.upper("status") == "ERROR", "FAILED").otherwise(F.upper("status"))
    valid = valid.withColumn("status", status)
    row = F.struct("seq", "status", *extra)
    closing = F.when(_is_terminal(F.col("status")), F.col("seq"))
    decided = valid.groupBy("execution_id").agg(
        F.min_by(row, closing).alias("_first"), F.max_by(row, "seq").alias("_last"),
    ).select(F.col("execution_id").alias("id"), F.coalesce("_first", "_last").alias("_d"))
    open_ = ~_is_terminal(F.col("status"))
    out = executions.join(decided, "id", "left")
    hit = open_ & F.col("_d").isNotNull()
    values = {"status": F.when(hit, F.col("_d.status")).otherwise(F.col("status"))}
    for c in extra:
        old = F.col(c) if c in executions.columns else F.lit(None)
        values[c] = F.when(hit, F.col(f"_d.{c}")).otherwise(old)
    values["applied_seq"] = F.when(hit, F.col("_d.seq"))
    out = out.withColumns({**values, "_hit": hit}).drop("_d")
    if "meta" in messages.columns and "meta" in executions.columns:
        out = _merge_meta(out, valid)
    return out.drop("_hit")


def enriched(messages: DataFrame) -> DataFrame:
    """Status messages with ``records_synced`` and with their own fields in ``meta``.

    Records are ``records_processed``, else the metadata's recordsProcessed, else its recordsInserted, else 0; blank or odd
    text counts as absent. Fields that a message has go over the metadata's entries of the same name, absent ones do not.
    """
    has = set(messages.columns)
    meta = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")) if "meta" in has else F.create_map().cast("map<string,string>")

    def whole(key: str) -> Column:
        text = blank_to_null(meta[key])
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))

    own = F.col("records_processed").cast("int") if "records_processed" in has else F.lit(None).cast("int")
    records = F.coalesce(own, *[whole(key) for key in _NUMERIC_META], F.lit(0)).cast("bigint")
    told = [x for key, c in _ENRICHED.items() if c in has for x in (F.lit(key), F.col(c).cast("string"))]
    if not told:
        return messages.withColumns({"records_synced": records, "meta": meta})
    fields = F.map_filter(F.create_map(*told), lambda _, v: v.isNotNull())
    kept = F.map_filter(meta, lambda k, _: ~F.map_contains_key(fields, k))
    return messages.withColumns({"records_synced": records, "meta": F.map_concat(kept, fields)})


def _merge_meta(out: DataFrame, valid: DataFrame) -> DataFrame:
    """Overlay message metadata, key by key; the number of keys per execution is small."""
    cut = out.where("applied_seq is not null").select(F.col("id").alias("execution_id"), "applied_seq")
    entries = valid.select("execution_id", "seq", F.explode("meta").alias("k", "v"))
    merged = (
        entries.join(cut, "execution_id").where(F.col("seq") <= F.col("applied_seq"))
        .groupBy("execution_id", "k").agg(F.max_by("v", "seq").alias("v"))
        .groupBy(F.col("execution_id").alias("id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_new"))
    )
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce("_new", empty)
    kept = F.map_filter(F.coalesce("meta", empty), lambda k, _: ~F.map_contains_key(new, k))
    return out.join(merged, "id", "left").withColumn("meta", F.map_concat(kept, new)).drop("_new")


def rollup(parents: DataFrame, children: DataFrame, now: datetime) -> DataFrame:
    """Parent executions recomputed from their children, one partial aggregation.

    RUNNING while a child is open, else FAILED if one failed, else SUCCESS. Without
    children: SUCCESS with zeros. A parent that is already terminal is not reopened.
    """
    def count_of(*states: str) -> Column:
        return F.count(F.when(F.col("status").isin(*states), 1))

    has = set(children.columns)
    agg = children.groupBy(F.col("parent_log_id").alias("id")).agg(
        F.count("*").alias("_n"), count_of("SUCCESS").alias("_success"), count_of("FAILED", "ERROR").alias("_failed"),
        count_of("PENDING").alias("_pending"), count_of("RUNNING").alias("_running"),
        F.min("started_at" if "started_at" in has else F.lit(None).cast("timestamp")).alias("_start"),
        F.max("finished_at" if "finished_at" in has else F.lit(None).cast("timestamp")).alias("_finish"),
        F.coalesce(F.sum("records_synced" if "records_synced" in has else F.lit(0)), F.lit(0)).alias("_synced"),
        F.coalesce(F.sum("records_skipped" if "records_skipped" in has else F.lit(0)), F.lit(0)).alias("_skipped"),
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("_n", "_success", "_failed", "_pending", "_running", "_synced", "_skipped")}
    out = parents.join(agg, "id", "left").withColumns(counts)
    childless = F.col("_n") == 0
    done = (F.col("_pending") + F.col("_running")) == 0
    status = (
        F.when(childless, "SUCCESS").when(~done, "RUNNING").when(F.col("_failed") > 0, "FAILED").otherwise("SUCCESS")
    )
    error = F.when(
        status == "FAILED", F.concat(F.col("_failed").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(" tasks failed"))
    )
    closed = _is_terminal(F.col("status"))
    fresh = {
        "status": status,
        "started_at": F.coalesce(F.col("_start"), F.col("started_at")),
        "finished_at": F.when(childless, F.lit(now)).when(done, F.coalesce(F.col("_finish"), F.col("finished_at"))),
        "records_synced": F.col("_synced"),
        "records_skipped": F.col("_skipped"),
        "error": error,
    }
    blank = {"started_at": "timestamp", "finished_at": "timestamp", "records_synced": "bigint", "records_skipped": "bigint", "error": "string"}
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in parents.columns})
    out = out.withColumns({c: F.when(closed, F.col(c)).otherwise(v) for c, v in fresh.items()})
    return out.withColumns(
        {"child_count": F.col("_n"), "success_count": F.col("_success"), "failed_count": F.col("_failed"),
         "pending_count": F.col("_pending"), "running_count": F.col("_running")}
    ).drop("_n", "_success", "_failed", "_pending", "_running", "_start", "_finish", "_synced", "_skipped")


def execution_notices(executions: DataFrame) -> DataFrame:
    """Severity, title and text of each terminal execution.

    ``child_count`` null or 0 marks a standalone run; otherwise the text counts its tasks.
    """
    ok = F.col("status") == "SUCCESS"
    title = F.coalesce(blank_to_null(F.col("title")), F.col("id").cast("string"))
    fan_out = F.coalesce(F.col("child_count"), F.lit(0)) > 0

    def share(c: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.lit("/"), F.col("child_count").cast("string"))

    text = (
        F.when(fan_out & ok, F.concat(share("success_count"), F.lit(" tasks completed successfully")))
        .when(fan_out, F.concat(share("failed_count"), F.lit(" tasks failed")))
        .when(ok, "Job completed successfully")
        .otherwise(F.coalesce(blank_to_null(F.col("error")), F.lit("Job failed")))
    )
    return executions.where(_is_terminal(F.col("status"))).select(
        "id", F.when(ok, "INFO").otherwise("ERROR").alias("severity"),
        F.concat(F.when(ok, "Job completed: ").otherwise("Job failed: "), title).alias("title"), text.alias("message"),
    )


def transition_failure_notices(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Failure text of a transition analysis: request fields, reason, progress.

    Fields come from the parent's metadata overlaid with that of its first failed child
    (smallest ``seq``), found by a map-side pick.
    """
    failed = children.where(F.col("status").isin("FAILED", "ERROR"))
    first = failed.groupBy(F.col("parent_log_id").alias("id")).agg(F.min_by("meta", "seq").alias("_child"))
    rows = parents.where("status = 'FAILED'").join(first, "id", "left")

    def field(key: str) -> Column:
        return F.coalesce(blank_to_null(F.col("_child")[key]), blank_to_null(F.col("meta")[key]))

    horizons = F.array_join(
        F.transform(F.split(F.replace(field("predictionHorizons"), F.lit(" ")), ","), lambda h: F.concat(F.lit("T"), h)), ", "
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Focus: "), F.coalesce(field("focusSectorCodes"), field("sectorCodes"), F.lit("UNKNOWN"))),
        *[
            F.concat(F.lit(f"{label}: "), F.coalesce(field(key), F.lit("UNKNOWN")))
            for label, key in (("Evaluation date", "evaluationDate"), ("Timeframe", "timeframe"), ("Strategy", "strategy"))
        ],
        F.concat(F.lit("Horizons: "), F.coalesce(horizons, F.lit("UNKNOWN"))),
        F.lit(""), F.lit("Reason:"),
        F.coalesce(field("errorMessage"), blank_to_null(F.col("error")), F.lit("Sector Transition analysis failed")),
        F.lit(""),
        F.format_string("Progress: %d succeeded / %d failed", F.col("success_count"), F.col("failed_count")),
    )
    return rows.select(
        "id", F.lit("ERROR").alias("severity"), F.lit("Sector Transition analysis failed").alias("title"), text.alias("message")
    )


def _has_changed() -> Column:
    return (F.col("status") == "SUCCESS") & F.coalesce(F.lower(F.col("meta")["signalChanged"]) == "true", F.lit(False))


def changed_signals(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Every signal change of the successful parent runs, one row each, whatever a digest's text lists."""
    meta = {"symbol_key": "symbolKey", "previous_signal": "previousSignal", "new_signal": "newSignal", "signal_date": "signalDate", "price": "price", "score": "score"}
    items = children.where(_has_changed()).select(F.col("parent_log_id").alias("id"), "seq", *[F.col("meta")[k].alias(c) for c, k in meta.items()])
    return items.join(parents.where("status = 'SUCCESS'").select("id"), "id", "left_semi")


def signal_digest(parents: DataFrame, children: DataFrame, listed_items: int = DIGEST_ITEMS) -> DataFrame:
    """Signal changes of each successful parent run as one text that lists ``listed_items`` of them.

    Counts and the first non-blank strategy/timeframe are partial aggregates over all items;
    :func:`changed_signals` has the items themselves. What the text lists is cut before it is gathered.
    """
    changed = _has_changed()

    def first_filled(key: str) -> Column:
        value = F.when(changed, blank_to_null(F.col("meta")[key]))
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("seq"))), F.lit("UNKNOWN"))

    head = children.groupBy(F.col("parent_log_id").alias("id")).agg(
        F.count("*").alias("total_children"), F.count(F.when(changed, 1)).alias("changed_count"),
        first_filled("strategy").alias("strategy"), first_filled("timeframe").alias("timeframe"),
    ).where("changed_count > 0")

    def shown(key: str, fallback: str) -> Column:
        return F.coalesce(blank_to_null(F.col("meta")[key]), F.lit(fallback))

    line = F.concat(
        F.lit("- "), F.coalesce(F.col("meta")["symbolKey"], F.lit("null")), F.lit(": "), shown("previousSignal", "BASELINE"), F.lit(" -> "),
        F.coalesce(F.col("meta")["newSignal"], F.lit("null")), F.lit(" @ "), shown("price", "n/a"), F.lit(" ("), shown("signalDate", "no date"),
        F.lit(", score="), shown("score", "n/a"), F.lit(")"),
    )
    listed = first_n(
        children.where(changed).select("parent_log_id", "seq", line.alias("line")),
        ["parent_log_id"], [F.col("seq").asc()], listed_items,
    ).groupBy(F.col("parent_log_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda i: i["line"]).alias("items")
    )
    intro = F.concat(
        F.col("changed_count").cast("string"), F.lit(" signal change(s) detected for strategy "), F.col("strategy"),
        F.lit(" on timeframe "), F.col("timeframe"), F.lit("."),
    )
    more = F.when(
        F.col("changed_count") > listed_items,
        F.concat(F.lit("..."), (F.col("changed_count") - listed_items).cast("string"), F.lit(" more changes omitted")),
    )
    return (
        parents.where("status = 'SUCCESS'").select("id").join(head, "id").join(listed, "id")
        .select(
            "id", "strategy", "timeframe", "total_children", "changed_count",
            F.concat_ws("\n", intro, F.array_join("items", "\n"), more).alias("message"),
        )
    )
