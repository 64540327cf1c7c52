"""Connected components of an edge list, by rounds that contract the graph.

In a round each node goes to the one of its neighbours and itself that comes
first in an order drawn anew for the round, and edges are kept between the nodes that
are left, at most three quarters of them on average.  So all rounds together move a few times the
first one's edges, and their number grows with the logarithm of the nodes.  The first in a neighbourhood is
folded by ``min_by`` and joined back, never gathered into a list, and nothing else in
the stage of a join needs a node's rows together, so Spark's adaptive execution can split a node
on a third of all edges over tasks.  Before each round a task replaces the
edges that it holds by a spanning star of each of their components, which ends
small inputs at once and thins out large ones.  What each round did is stored as a table, and
at the end nodes follow the rounds to the one that they became.  Only a count comes to the driver.  What is left
of ``FEW`` edges at most is ended in one such step of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.arrow import mapped
from ledgerloom.checkpoints import removed, stored

MAX_ROUNDS = 200
#: Edges that a task holds at once.
CHUNK = 1 << 19
#: Edges that are ended in one step of one task, at most.
FEW = CHUNK


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least node of the component, by hooking roots and halving paths."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task's chunks as stars around the least node of each of their components."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = least_labels(place[: len(a)], place[len(a) :], len(nodes))
        far = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            size += x.num_rows
            if size >= CHUNK:
                yield stars(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    return mapped(edges, task, "a long, b long")


def _order(c: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), c)


def _firsts(edges: DataFrame, number: int) -> DataFrame:
    """(node, to) of every node: the first, in the round's order, of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min_by("b", _order("b", number)).alias("m"))
    return first.select(F.col("a").alias("node"), F.when(_order("m", number) < _order("a", number), F.col("m")).otherwise(F.col("a")).alias("to"))


def _moved(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """The edges between the nodes that theirs went to."""
    for end in ("a", "b"):
        edges = edges.join(firsts.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _is_few(edges: DataFrame, few: int) -> bool:
    return edges.limit(few + 1).count() <= few


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the least node.

    few: edges that one task may end, in the place of ``FEW``; 0 leaves all to the rounds.
    Loops and edges with a null end are left out; repeated edges count once; no edges give an empty table.
    """
    spark, few = edges.sparkSession, FEW if few is None else few
    now = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b")
    now, at = stored(_contracted(now))
    rounds: list[tuple[DataFrame, str]] = []
    while not _is_few(now, few):
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"not done after {MAX_ROUNDS} rounds")
        rounds.append(stored(_firsts(now, len(rounds))))
        last, before = at, now
        now, at = stored(_contracted(_moved(before, rounds[-1][0])))
        removed(spark, last)
    ended, end = stored(_contracted(now.coalesce(1)))
    removed(spark, at)
    found = ended.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ended.select("b", "b").distinct())
    if not rounds:
        return found
    for firsts, _ in reversed(rounds):
        found = firsts.join(found.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    found, at = stored(found)
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    out, _ = stored(found.join(least, "component").select("node", F.col("least").alias("component")))
    for path in (at, end, *(p for _, p in rounds)):
        removed(spark, path)
    return out
