"""Stateful streams that event-time timers drive: rows wait for the watermark, and what is over leaves the state."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import date
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlake.operators import executions as ex

__all__ = ["ordered_signal_changes", "status_with_expiry"]

_CLOSED = ("SUCCESS", "FAILED", "ERROR")
_CHANGE = "symbol_key string, strategy string, timeframe string, signal_date date, previous_signal string, new_signal string"


def _millis(day: date) -> int:
    return calendar.timegm(day.timetuple()) * 1000


class _OrderedChanges(StatefulProcessor):
    """Holds a key's days until the watermark has passed them, then walks them in order.

    A key holds one row per trading day within the allowed lateness. One timer is set at a time, for the first day held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "signal string, day date")
        self.held = handle.getMapState("held", "day date", "signal string")
        self.timer = handle.getValueState("timer", "at long")

    def _wait_for(self, at: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is not None and (at is None or at != before):
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        elif at != before:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        done = self.last.get()[1] if self.last.exists() else None
        watermark = timer_values.getCurrentWatermarkInMs()
        first = None
        for chunk in rows:
            deciding = chunk[chunk["signal"] != "NO_DECISION"]
            for day, signal in zip(deciding["signal_date"], deciding["signal"]):
                if (done is not None and day <= done) or _millis(day) < watermark:
                    continue
                if self.held.containsKey((day,)) and self.held.getValue((day,))[0] >= signal:
                    continue  # of rows that repeat a day the last by name counts, in whatever order they come
                self.held.updateValue((day,), (signal,))
                first = day if first is None else min(first, day)
        if first is not None:
            waiting = self.timer.get()[0] if self.timer.exists() else None
            self._wait_for(_millis(first) if waiting is None else min(waiting, _millis(first)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        days = sorted((d, s) for (d,), (s,) in self.held.iterator())
        ready = [x for x in days if _millis(x[0]) <= watermark]
        out, previous = [], self.last.get()[0] if self.last.exists() else None
        for day, signal in ready:
            if previous is not None and previous != signal:
                out.append((*key, day, previous, signal))
            previous = signal
            self.held.removeKey((day,))
        if ready:
            self.last.update((previous, ready[-1][0]))
        self.timer.clear()
        if len(ready) < len(days):
            self._wait_for(_millis(days[len(ready)][0]))
        if out:
            yield pd.DataFrame(out, columns=["symbol_key", "strategy", "timeframe", "signal_date", "previous_signal", "new_signal"])

    def close(self) -> None:
        pass


def ordered_signal_changes(signals: DataFrame, lateness: str) -> DataFrame:
    """Change events along each (symbol, strategy, timeframe), whatever order the rows come in within ``lateness``.

    Rows wait for the watermark and are applied by date; a row for a day not after the last one applied is dropped.
    NO_DECISION rows move the watermark and are passed over.
    """
    keys = ["symbol_key", "strategy", "timeframe"]
    timed = signals.withColumn("signal_time", F.col("signal_date").cast("timestamp")).withWatermark("signal_time", lateness)
    return timed.select(*keys, "signal_date", "signal", "signal_time").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_OrderedChanges(), outputStructType=_CHANGE, outputMode="Append", timeMode="EventTime",
    )


class _StatusWithExpiry(StatefulProcessor):
    """First terminal status wins; a closed execution is forgotten some time after its closing message."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "status string, seq long, expires long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] in _CLOSED:
            return
        closing, latest = None, None
        for chunk in rows:
            status = chunk["status"].replace("ERROR", "FAILED")
            at = chunk["ts"].astype("int64") // (10 ** 3 if chunk["ts"].dtype == "datetime64[us]" else 10 ** 6)
            closed = chunk[status.isin(_CLOSED)]
            if len(closed):
                i = closed["seq"].idxmin()
                if closing is None or closed["seq"][i] < closing[1]:
                    closing = (status[i], int(closed["seq"][i]), int(at[i]))
            i = chunk["seq"].idxmax()
            if latest is None or chunk["seq"][i] > latest[1]:
                latest = (status[i], int(chunk["seq"][i]), int(at[i]))
        if closing is None and self.state.exists() and self.state.get()[1] > latest[1]:
            return
        status, seq, at_ms = closing or latest
        expires = at_ms + self.keep
        self.state.update((status, seq, expires))
        if closing is not None:
            self.handle.registerTimer(max(expires, timer_values.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"execution_id": [key[0]], "status": [status], "seq": [seq]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def status_with_expiry(messages: DataFrame, lateness: str, keep_closed_seconds: float) -> DataFrame:
    """Changes of execution state as :func:`jobs.status_stream_state` gives them, with a state that does not grow for ever.

    ``messages`` also has ``ts``. A closed execution stays in the state for ``keep_closed_seconds`` of event time after its
    closing message, so that late updates within that time are ignored; then it is dropped.
    """
    valid = messages.where(ex._reason(None, False, False).isNull()).withColumn("status", F.upper("status")).withWatermark("ts", lateness)
    return valid.select("execution_id", "status", "seq", "ts").groupBy("execution_id").transformWithStateInPandas(
        statefulProcessor=_StatusWithExpiry(int(keep_closed_seconds * 1000)), outputStructType="execution_id string, status string, seq long",
        outputMode="Update", timeMode="EventTime",
    )
