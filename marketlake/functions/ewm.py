"""Exponentially decayed sums as window functions.

For a series ``x_0, x_1, ...`` and a decay ``d`` the operator gives
``y_i = x_i + d * y_{i-1}``. The recursion is split into blocks of ``BLOCK`` rows:

* inside a block, ``y`` is ``d^j * sum(x_k * d^-k)``, one running sum whose factors stay
  far from the float limits because ``k < BLOCK``;
* the value at the end of a block is carried on from the two blocks before. The weight of
  anything older is at most ``d^(2*BLOCK)``, below 1e-16 for every decay allowed here, so
  the result equals the recursion to rounding.

Both steps share one partitioning (the series key) and one sort by block and position. Sums along
the same index share these too: ``in_blocks`` once, then ``block_sums`` as often as wanted and
``along`` for plain windows between them. Windows in another order (by date) belong before them,
as each change of order costs a sort of the task's rows. Series are daily bars: their length is
bounded by the number of trading days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

__all__ = ["BLOCK", "along", "block_sums", "decayed_sums", "in_blocks", "leave_blocks"]

BLOCK = 256
_MAX_DECAY = 10 ** (-16 / (2 * BLOCK))


def in_blocks(df: DataFrame, index: str) -> DataFrame:
    """Number the blocks of a series and the rows within them, for ``block_sums`` and ``along``."""
    return df.withColumns({"_blk": F.floor(F.col(index) / BLOCK), "_pos": F.col(index) % BLOCK})


def leave_blocks(df: DataFrame) -> DataFrame:
    return df.drop("_blk", "_pos")


def along(keys: Sequence[str]) -> WindowSpec:
    """The series in index order; rows outside it (null index) come first."""
    return W.partitionBy(*keys).orderBy("_blk", "_pos")


def decayed_sums(
    df: DataFrame, keys: Sequence[str], index: str, terms: Mapping[str, tuple[Column, float]]
) -> DataFrame:
    """Add one column per term: the decayed sum of its expression along ``index``.

    ``index`` numbers the rows of a series from 0 without gaps; a null index marks a row
    outside the series and gets null.
    """
    return leave_blocks(block_sums(in_blocks(df, index), keys, index, terms))


def block_sums(
    df: DataFrame, keys: Sequence[str], index: str, terms: Mapping[str, tuple[Column, float]]
) -> DataFrame:
    """``decayed_sums`` of rows that ``in_blocks`` has numbered by the same index."""
    for name, (_, decay) in terms.items():
        if not 0 < decay <= _MAX_DECAY:
            raise ValueError(f"decay of {name} must be within (0, {_MAX_DECAY:.4f}]")
    inner = W.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    pos = F.col("_pos").cast("double")
    df = df.withColumns(
        {
            f"_l_{name}": F.sum(x * F.pow(F.lit(decay), -pos)).over(inner) * F.pow(F.lit(decay), pos)
            for name, (x, decay) in terms.items()
        }
    )
    blocks = W.partitionBy(*keys).orderBy("_blk")
    at_end = F.col("_pos") == BLOCK - 1
    carried = {}
    for name, (_, decay) in terms.items():
        end = F.when(at_end, F.col(f"_l_{name}"))
        back = [F.coalesce(F.max(end).over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) for k in (1, 2)]
        carry = back[0] + back[1] * F.lit(decay**BLOCK)
        carried[name] = F.when(
            F.col(index).isNotNull(), F.col(f"_l_{name}") + F.pow(F.lit(decay), pos + 1.0) * carry
        )
    return df.withColumns(carried).drop(*[f"_l_{n}" for n in terms])
