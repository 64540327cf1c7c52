"""Scalar functions of transactions and amounts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sequence numbers under which an input signals replacement, and under which a relative locktime is active.
RBF_BELOW = 0xFFFFFFFE
RELATIVE_BELOW = 0x80000000
#: The first block reward in satoshi, the blocks between its halvings, and the number of halvings after which it is gone.
FIRST_SUBSIDY, HALVING, HALVINGS = 5_000_000_000, 210_000, 64


def signals_rbf(sequence: Column) -> Column:
    return sequence < F.lit(RBF_BELOW)


def relative_locktime(sequence: Column) -> Column:
    return sequence < F.lit(RELATIVE_BELOW)


def hamming_weight(n: Column) -> Column:
    """Decimal digits that are not 0."""
    return F.length(F.regexp_replace(n.cast("string"), "[-0]", ""))


def piecewise_linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """Straight lines between the points (by ascending x), level outside of them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0))
    return out.otherwise(F.lit(points[-1][1]))


def block_subsidy(height: Column) -> Column:
    halvings = F.floor(height / HALVING)
    return F.when(halvings >= HALVINGS, F.lit(0).cast("long")).otherwise(F.floor(F.lit(FIRST_SUBSIDY) / F.pow(F.lit(2.0), halvings)).cast("long"))


def subset_cost(n: Column, budget: Column) -> Column:
    """The privacy cost of n ambiguous subsets: all of the budget without any."""
    return budget * F.when(n == 0, F.lit(1.0)).otherwise(1.0 / (1.0 + n))
