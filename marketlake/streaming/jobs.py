"""Streams of commands, statuses, signals and notices."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlake.operators import commands, executions as ex

__all__ = [
    "cooldown_stream", "decoded_commands", "parent_stream", "route_commands", "signal_change_stream",
    "status_stream_state",
]

_CLOSED = ("SUCCESS", "FAILED", "ERROR")


def decoded_commands(payloads: DataFrame) -> DataFrame:
    """Payload stream (``value``, ``kind``) to checked commands; works on batches too."""
    return commands.validated(commands.decode_json(payloads))


def route_commands(root: str):
    """foreachBatch writer: valid commands by kind, ERROR statuses of invalid ones, malformed
    payloads aside. Each batch overwrites its own folder, so a retry does not repeat rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = batch.where("not malformed and size(violations) = 0").drop("malformed", "violations")
            bad = batch.where("not malformed and size(violations) > 0")
            now = F.lit("1970-01-01 00:00:00").cast("timestamp") if "received_at" not in batch.columns else F.col("received_at")
            parts = {
                "commands": good, "errors": commands.error_status(bad, now, now),
                "malformed": batch.where("malformed").select("value"),
            }
            for name, part in parts.items():
                part.write.mode("overwrite").json(f"{root}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


class _FirstTerminal(StatefulProcessor):
    """Per execution: the first terminal status closes it, before that the latest one counts.

    Within a batch both are found by min/max of the arrival number, so chunks may come in
    any order and none is kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "status string, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        closing, latest = None, None
        for chunk in rows:
            status = chunk["status"].replace("ERROR", "FAILED")
            closed = chunk[status.isin(_CLOSED)]
            if len(closed):
                i = closed["seq"].idxmin()
                if closing is None or closed["seq"][i] < closing[1]:
                    closing = (status[i], int(closed["seq"][i]))
            i = chunk["seq"].idxmax()
            if latest is None or chunk["seq"][i] > latest[1]:
                latest = (status[i], int(chunk["seq"][i]))
        if self.state.exists() and self.state.get()[0] in _CLOSED:
            return
        chosen = closing or latest
        if chosen is not None:
            self.state.update(chosen)
            yield pd.DataFrame({"execution_id": [key[0]], "status": [chosen[0]], "seq": [chosen[1]]})

    def close(self) -> None:
        pass


def status_stream_state(messages: DataFrame) -> DataFrame:
    """Changes of execution state; the last row per execution equals ``apply_statuses``."""
    valid = messages.where(ex._reason(None, False, False).isNull()).withColumn("status", F.upper("status"))
    return valid.select("execution_id", "status", "seq").groupBy("execution_id").transformWithStateInPandas(
        statefulProcessor=_FirstTerminal(), outputStructType="execution_id string, status string, seq long",
        outputMode="Update", timeMode="None",
    )


class _Parent(StatefulProcessor):
    """Counts of a parent's children, kept per child so that a repeat replaces and does not add."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.children = handle.getMapState("children", "child string", "status string, records long")
        self.counts = handle.getValueState("counts", "success long, failed long, open long, records long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        success, failed, opened, records, done = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, False)
        if done:
            return
        for chunk in rows:
            for child, status, amount in zip(chunk["id"], chunk["status"], chunk["records_synced"]):
                status = "FAILED" if status == "ERROR" else status
                name = (str(child),)
                if self.children.containsKey(name):
                    old, had = self.children.getValue(name)
                    if old in _CLOSED:
                        continue
                    opened, records = opened - 1, records - had
                self.children.updateValue(name, (status, int(amount)))
                success += status == "SUCCESS"
                failed += status == "FAILED"
                opened += status not in _CLOSED
                records += int(amount)
        expected = success + failed + opened
        finished = opened == 0 and expected > 0
        state = "RUNNING" if not finished else "FAILED" if failed else "SUCCESS"
        self.counts.update((success, failed, opened, records, finished))
        yield pd.DataFrame(
            {"id": [key[0]], "status": [state], "child_count": [expected], "success_count": [success],
             "failed_count": [failed], "records_synced": [records], "completed": [finished]}
        )

    def close(self) -> None:
        pass


def parent_stream(children: DataFrame) -> DataFrame:
    """Parent state after each batch of child statuses; ``completed`` is true exactly once.

    A parent is complete when every child *seen so far* is closed, so children have to be
    announced (PENDING) before the last one closes, as a fan-out does.
    """
    return children.select("parent_log_id", "id", "status", "records_synced").groupBy("parent_log_id").transformWithStateInPandas(
        statefulProcessor=_Parent(),
        outputStructType="id long, status string, child_count long, success_count long, failed_count long, records_synced long, completed boolean",
        outputMode="Update", timeMode="None",
    )


class _SignalChange(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "signal string, day date")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        # one row per trading day and key: a batch holds few of them
        days = pd.concat(list(rows)).sort_values("signal_date")
        previous = self.last.get()[0] if self.last.exists() else None
        day, out = None, []
        for row in days.itertuples():
            if previous is not None and previous != row.signal:
                out.append((*key, row.signal_date, previous, row.signal))
            previous, day = row.signal, row.signal_date
        if day is not None:
            self.last.update((previous, day))
        if out:
            yield pd.DataFrame(out, columns=["symbol_key", "strategy", "timeframe", "signal_date", "previous_signal", "new_signal"])

    def close(self) -> None:
        pass


def signal_change_stream(signals: DataFrame) -> DataFrame:
    """Change events along each (symbol, strategy, timeframe); NO_DECISION rows are passed over."""
    keys = ["symbol_key", "strategy", "timeframe"]
    deciding = signals.where("signal <> 'NO_DECISION'").select(*keys, "signal_date", "signal")
    return deciding.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_SignalChange(),
        outputStructType="symbol_key string, strategy string, timeframe string, signal_date date, previous_signal string, new_signal string",
        outputMode="Append", timeMode="None",
    )


class _Cooldown(StatefulProcessor):
    def __init__(self, cooldown_us: int, ttl_ms: int | None) -> None:
        self.cooldown, self.ttl = cooldown_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "at long, suppressed long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        # repeats at one instant are reduced per chunk, so a batch is held as its distinct times
        per_time = {"event_id": "min", "n": "sum"}
        chunks = [chunk.assign(n=1).groupby("t", as_index=False).agg(per_time) for chunk in rows]
        moments = pd.concat(chunks).groupby("t", as_index=False).agg(per_time)
        times, ids = moments["t"].to_numpy(), moments["event_id"].to_numpy()
        before = np.concatenate([[0], np.cumsum(moments["n"].to_numpy())])
        anchor, suppressed = self.anchor.get() if self.anchor.exists() else (None, 0)
        at = 0 if anchor is None else int(np.searchsorted(times, anchor + self.cooldown))
        suppressed += int(before[at])
        out = []
        while at < len(times):
            out.append((key[0], int(times[at]), int(ids[at]), suppressed))
            anchor = int(times[at])
            following = int(np.searchsorted(times, anchor + self.cooldown))
            suppressed, at = int(before[following] - before[at] - 1), following
        self.anchor.update((anchor, suppressed))
        if out:
            yield pd.DataFrame(out, columns=["dedup_key", "t", "event_id", "delivered_suppressed"])

    def close(self) -> None:
        pass


def cooldown_stream(notices: DataFrame, cooldown_seconds: float, key: str = "dedup_key", ttl_seconds: float | None = None) -> DataFrame:
    """Retained notices as they come, with the number of repeats suppressed before each.

    The state is one row per key. ``ttl_seconds`` drops keys not seen for that long, which
    bounds the state; a dropped key forgets its undelivered count. Of a key's rows in one
    batch only the distinct times are held in memory.
    """
    rows = notices.select(F.col(key).alias("dedup_key"), F.unix_micros("ts").alias("t"), "event_id")
    ttl = int(ttl_seconds * 1000) if ttl_seconds else None
    out = rows.groupBy("dedup_key").transformWithStateInPandas(
        statefulProcessor=_Cooldown(int(cooldown_seconds * 1_000_000), ttl),
        outputStructType="dedup_key string, t long, event_id long, delivered_suppressed long",
        outputMode="Append", timeMode="ProcessingTime" if ttl else "None",
    )
    return out.withColumn("ts", F.timestamp_micros("t")).drop("t")
