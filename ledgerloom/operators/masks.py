"""Masks: (key, flag) with a key at most once.  A key that is missing is not the same as a false one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(items: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Items whose flag is true; a missing key drops the item."""
    return items.join(mask.where("flag").select(F.col("key").alias(key)), key, "left_semi")


def exclude(items: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Items whose flag is not true; a missing key keeps the item."""
    return items.join(mask.where("flag").select(F.col("key").alias(key)), key, "left_anti")


def negate(mask: DataFrame) -> DataFrame:
    return mask.select("key", (~F.col("flag")).alias("flag"))


def _both(left: DataFrame, right: DataFrame):  # noqa: ANN202
    joined = left.select("key", F.col("flag").alias("l")).join(right.select("key", F.col("flag").alias("r")), "key", "full")
    return joined, F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """And, over the keys of either; a missing key is false."""
    joined, l, r = _both(left, right)  # noqa: E741
    return joined.select("key", (l & r).alias("flag"))


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Or, over the keys of either; a missing key is false."""
    joined, l, r = _both(left, right)  # noqa: E741
    return joined.select("key", (l | r).alias("flag"))
