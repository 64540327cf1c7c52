"""Short labels of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.arrow import column

_RAISED = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def _power(n: int, base: int) -> int | None:
    """k with base ** k = n, or None."""
    k = 0
    while n > 1 and n % base == 0:
        n, k = n // base, k + 1
    return k if n == 1 else None


def amount_label(n: int) -> str:
    """2ⁿ, 3ⁿ, 2×3ⁿ, then 1, 2 or 5 times a power of ten, else the number."""
    raised = lambda k: str(k).translate(_RAISED)
    if n < 1:
        return str(n)
    for base in (2, 3):
        if (k := _power(n, base)) is not None:
            return f"{base}{raised(k)}"
    if n % 2 == 0 and (k := _power(n // 2, 3)) is not None:
        return f"2×3{raised(k)}"
    for factor in (1, 2, 5):
        if n % factor == 0 and (k := _power(n // factor, 10)) is not None:
            if k == 0:
                return str(factor)
            return f"10{raised(k)}" if factor == 1 else f"{factor}×10{raised(k)}"
    return str(n)


#: The largest amount that a column holds.
MOST = (1 << 63) - 1


def marked() -> list[tuple[int, str]]:
    """The amounts that have a label of their own, with it."""
    powers = [b**k for b in (2, 3, 10) for k in range(64)]
    found = {n for p in powers for n in (p, 2 * p, 5 * p) if n <= MOST}
    return [(n, label) for n in sorted(found) if (label := amount_label(n)) != str(n) or n < 10]


def labelled(df: DataFrame, amount: str) -> DataFrame:
    """df with a label of its amounts: a join with the few that have one (a broadcast of less than 300 rows)."""
    table = df.sparkSession.createDataFrame(marked(), "__amount long, __label string")
    both = df.join(F.broadcast(table), column(amount) == F.col("__amount"), "left")
    return both.select(*[column(c) for c in df.columns], F.coalesce("__label", column(amount).cast("string")).alias("label"))
