"""Joins of rows that lie near each other, through a grid that is fine only where rows are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.session import stored

COARSE_BITS = 3  # a coarse cell is eight fine ones wide
ORIGIN = 2  # fine cells before zero, so that what lies just above zero reaches no cell below it
DENSE_ROWS = 256  # left rows of a coarse cell from which on fine cells are used
PAD = 1.000001  # a reach is widened by this, so that rounding loses no pair


def near_rows(left: DataFrame, right: DataFrame, *, keys: list[str], at: list[str], to: list[str],
              reach: float | tuple[str, str]) -> DataFrame:
    """Rows of both sides of one group that are no further apart than ``reach`` on any axis, and some that are.

    ``at`` and ``to`` name the coordinates of the left and the right; ``reach`` is a number or the names of a column of
    each side that holds it, equal within a group.  A left row lies in one cell, a right row goes to every cell it
    reaches: of a grid eight times as wide as the reach, where most rows reach one cell only, and in cells with many
    left rows of a grid as wide as the reach.  A right row so meets no more than a bounded number of left rows in vain,
    whatever the density.  The sides are never broadcast: Spark does not count what an explode adds.
    """
    mine, theirs = (F.lit(reach), F.lit(reach)) if isinstance(reach, (int, float)) else map(F.col, reach)
    axes = range(len(at))
    coarse, fine = [f"__k{i}" for i in axes], [f"__f{i}" for i in axes]

    def cell(c: Column, r: Column) -> Column:
        return F.floor(c / r).cast("bigint") + ORIGIN

    placed = left.select("*", *[F.shiftright(cell(F.col(c), mine), COARSE_BITS).alias(k) for c, k in zip(at, coarse)])
    spread = right
    for c, k in zip(to, coarse):
        low, high = (cell(F.col(c) + side * theirs * PAD, theirs) for side in (-1, 1))
        spread = spread.withColumn(k, F.explode(F.sequence(F.shiftright(low, COARSE_BITS), F.shiftright(high, COARSE_BITS))))
    by = [*keys, *coarse]
    dense = stored(placed.groupBy(*by).count().filter(F.col("count") > DENSE_ROWS).select(*by, F.lit(True).alias("__dense")), "dense")
    if dense.isEmpty():
        return placed.join(spread.hint("merge"), by).drop(*coarse)
    placed, spread = (side.join(dense, by, "left") for side in (placed, spread))
    for c, f in zip(at, fine):
        placed = placed.withColumn(f, F.when(F.col("__dense"), cell(F.col(c), mine)).otherwise(0))
    for c, k, f in zip(to, coarse, fine):
        low, high = (cell(F.col(c) + side * theirs * PAD, theirs) for side in (-1, 1))
        first = F.shiftleft(F.col(k), COARSE_BITS)
        reached = F.sequence(F.greatest(low, first), F.least(high, first + 2**COARSE_BITS - 1))
        spread = spread.withColumn(f, F.explode(F.when(F.col("__dense"), reached).otherwise(F.array(F.lit(0).cast("bigint")))))
    return placed.drop("__dense").join(spread.drop("__dense").hint("merge"), [*by, *fine]).drop(*coarse, *fine)
