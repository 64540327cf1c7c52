"""What the facts of several evaluations of one node add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.clustering import cluster, star


def combine_masks(facts: list[DataFrame]) -> DataFrame:
    """A later fact's flag counts for its key."""
    numbered = [f.select("key", "flag", F.lit(k).alias("no")) for k, f in enumerate(facts)]
    return reduce(DataFrame.union, numbered).groupBy("key").agg(F.max_by("flag", "no").alias("flag"))


def combine_sets(facts: list[DataFrame]) -> DataFrame:
    """Bags one after the other."""
    return reduce(DataFrame.unionByName, facts)


def combine_clusterings(facts: list[DataFrame]) -> DataFrame:
    """The join of all."""
    return cluster(reduce(DataFrame.union, [star(f) for f in facts]))
