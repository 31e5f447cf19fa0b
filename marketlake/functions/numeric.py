"""Null-safe arithmetic and gated window aggregates.

House rules, applied by every operator:

* a NaN at ingest is a null (``nan_to_null``), so comparisons and aggregates never see one;
* dividing by zero or null gives null, under ANSI mode too (``safe_div``);
* a rolling statistic over ``n`` rows is null until ``n`` non-null values are in the frame;
* a mean of prices carries the rounding of its sum: it is compared by ``is_above``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec

__all__ = ["compounded", "gated_avg", "is_above", "nan_to_null", "rolling", "safe_div", "to_double"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_double(c: Column | str) -> Column:
    """Numeric coercion: unparsable text and NaN both become null."""
    return nan_to_null(_col(c).try_cast("double"))


def safe_div(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def is_above(a: Column | str, b: Column | str) -> Column:
    """``a > b`` by more than the rounding of a mean, so that equal means over different windows are equal.

    A sum of n doubles is off by at most n * 1.1e-16 of its size; prices in cents and their means
    over fewer than 10 000 rows differ by 1e-9 of theirs at least.
    """
    a, b = _col(a), _col(b)
    return a - b > F.greatest(F.abs(a), F.abs(b)) * 1e-12


def rolling(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows including the current one."""
    return w.rowsBetween(-(n - 1), 0)


def gated_avg(c: Column | str, w: WindowSpec, n: int) -> Column:
    """Mean of the last ``n`` rows, null unless all ``n`` are present and non-null."""
    c, frame = _col(c), rolling(w, n)
    return F.when(F.count(c).over(frame) >= n, F.avg(c).over(frame))


def compounded(c: Column | str, frame: WindowSpec, n: int | None = None) -> Column:
    """``prod(1 + r) - 1`` over a frame.

    Without ``n`` a null return counts as 0; with ``n`` the result is null unless
    the frame holds ``n`` non-null returns.
    """
    c = _col(c)
    if n is None:
        return F.product(F.lit(1.0) + F.coalesce(c, F.lit(0.0))).over(frame) - 1.0
    return F.when(F.count(c).over(frame) == n, F.product(F.lit(1.0) + c).over(frame) - 1.0)
