"""What the corpus operators share: names, tables, checkpoints, small text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.arrow import column, mapped, quoted
from ledgerloom.checkpoints import cut

__all__ = ["LOWER", "UPPER", "ascii_lower", "column", "cut", "free", "fresh", "mapped", "quoted", "table", "total"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new, k = f"__{name}", 0
        while new.lower() in taken:
            k += 1
            new = f"__{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def free(df: DataFrame, name: str) -> str:
    """The name itself where df does not have it, else a fresh one."""
    return name if name.lower() not in {c.lower() for c in df.columns} else fresh(df, name)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
