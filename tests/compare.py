"""Order-insensitive comparison of two pandas frames by column name."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return "~"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        if math.isnan(value):
            return "~"
        return str(int(value)) if float(value).is_integer() else repr(round(float(value), 9))
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        return value.strftime("%Y-%m-%d") if (value.hour, value.minute, value.second, value.microsecond) == (0, 0, 0, 0) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(zip(*[[_cell(v) for v in ordered[c].tolist()] for c in ordered.columns]))


def diff_rows(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        extra = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)}; only got/want: {extra}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0][0]} vs {wrong[0][1]}"
    return None
