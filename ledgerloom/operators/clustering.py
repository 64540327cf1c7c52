"""Clusterings of outputs: (member, cluster_id), cluster_id the least member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut, removed, stored
from ledgerloom.ledger import Ledger
from ledgerloom.operators.components import components

MAX_ROUNDS = 1000


def cluster(edges: DataFrame, members: DataFrame | None = None, few: int | None = None) -> DataFrame:
    """Clusters of the edges (a, b); members (member) without an edge are clusters of their own; few as in ``components``."""
    edges, at = stored(edges.select("a", "b"))
    out = components(edges, few).select(F.col("node").alias("member"), F.col("component").alias("cluster_id"))
    loops = edges.where("a = b").select(F.col("a").alias("member"))
    if members is None and not loops.limit(1).count():
        removed(edges.sparkSession, at)
        return out
    alone = (loops if members is None else members.select("member").union(loops)).distinct()
    return out.union(alone.join(out, "member", "left_anti").select("member", F.col("member").alias("cluster_id")))


def star(clustering: DataFrame) -> DataFrame:
    """A clustering as edges, loops included, which stand for it in ``cluster``."""
    return clustering.select(F.col("member").alias("a"), F.col("cluster_id").alias("b"))


def _merged(clustering: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of more edges (a, b): the clusters that they touch with the one that each goes to, and their ends that are new."""
    label = lambda end: clustering.select(F.col("member").alias(end), F.col("cluster_id").alias(f"c{end}"))
    known = edges.where("a <> b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    moved = components(known.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("node").alias("cluster_id"), "component")
    ends = edges.select(F.col("a").alias("member")).union(edges.select("b")).where("member IS NOT NULL").distinct()
    return moved, ends.join(clustering.select("member"), "member", "left_anti").select("member", F.col("member").alias("cluster_id"))


def _relabelled(clustering: DataFrame, moved: DataFrame, how: str) -> DataFrame:
    return clustering.join(moved, "cluster_id", how).select("member", F.coalesce("component", "cluster_id").alias("cluster_id"))


def grown(clustering: DataFrame, edges: DataFrame) -> DataFrame:
    """The clustering with more edges (a, b); their ends become members, loops too.

    Only the clusters that the edges touch are clustered again, as nodes
    themselves; the members of others keep their labels without a round.
    """
    moved, new = _merged(clustering, edges)
    return _relabelled(clustering.select("member", "cluster_id").union(new), moved, "left")


def changes(clustering: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``grown`` that the clustering does not have: members with a smaller label than before, and new ones."""
    moved, new = _merged(clustering, edges)
    fallen = _relabelled(clustering.select("member", "cluster_id"), moved.where("component <> cluster_id"), "inner")
    return fallen.union(_relabelled(new, moved, "left"))


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The finest clustering that both refine."""
    return grown(stored(left)[0], stored(star(right))[0])


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(member, left_id, right_id) of the members that two clusterings label otherwise, or that only one has; none for equal ones."""
    both = left.select("member", F.col("cluster_id").alias("left_id")).join(right.select("member", F.col("cluster_id").alias("right_id")), "member", "full")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two clusterings are the same partition of the same members: labels are the least members, so they compare."""
    return differences(left, right).isEmpty()


def multi_input_edges(ledger: Ledger, txs: DataFrame | None = None) -> DataFrame:
    """Each transaction's first resolved spent output with its others; a single one gives no member."""
    spent = ledger.txin.where("prev_out_id IS NOT NULL").select("tx_id", "vin", "prev_out_id")
    if txs is not None:
        spent = spent.join(txs.select("tx_id").distinct(), "tx_id", "left_semi")
    first = spent.groupBy("tx_id").agg(F.min_by("prev_out_id", "vin").alias("first"))
    return spent.join(first, "tx_id").where("prev_out_id <> first").select(F.col("prev_out_id").alias("a"), F.col("first").alias("b"))


def change_edges(ledger: Ledger, change: DataFrame) -> DataFrame:
    """Change outputs (mask) with the output that vin 0 of their transaction spends; none where that is unresolved."""
    first = ledger.txin.where("vin = 0 AND prev_out_id IS NOT NULL").select("tx_id", F.col("prev_out_id").alias("b"))
    outs = ledger.txout.select("out_id", "tx_id").join(change.where("flag").select(F.col("key").alias("out_id")), "out_id", "left_semi")
    return outs.join(first, "tx_id").select(F.col("out_id").alias("a"), "b")


def same_script(ledger: Ledger, outs: DataFrame | None = None) -> DataFrame:
    """Outputs with the first one of the same script in the whole ledger; components by themselves."""
    first = ledger.txout.groupBy("spk").agg(F.min("out_id").alias("cluster_id"))
    some = ledger.txout.select("out_id", "spk") if outs is None else ledger.txout.select("out_id", "spk").join(outs.select("out_id").distinct(), "out_id", "left_semi")
    both = some.join(first, "spk").select(F.col("out_id").alias("member"), "cluster_id")
    return both if outs is None else both.union(both.select(F.col("cluster_id").alias("member"), "cluster_id")).distinct()


def is_unilateral(ledger: Ledger, clustering: DataFrame, txs: DataFrame | None = None) -> DataFrame:
    """Transactions whose resolved spent outputs are of one cluster; none is false, one is true, an unknown one is its own cluster.

    txs (tx_id, distinct): those to be told, or all.
    """
    spent = ledger.txin.where("prev_out_id IS NOT NULL").select("tx_id", F.col("prev_out_id").alias("member"))
    asked = ledger.tx.select("tx_id") if txs is None else txs
    spent = spent if txs is None else spent.join(txs, "tx_id", "left_semi")
    named = spent.join(clustering, "member", "left").withColumn("c", F.coalesce("cluster_id", "member"))
    by = named.groupBy("tx_id").agg((F.min("c") == F.max("c")).alias("flag"))
    return asked.join(by, "tx_id", "left").select(F.col("tx_id").alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"))


def sizes(clustering: DataFrame) -> DataFrame:
    return clustering.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def unilateral_fixpoint(ledger: Ledger, change: DataFrame, mixes: DataFrame) -> DataFrame:
    """The least clustering that holds the multi-input clusters of transactions that do not mix, and change of every transaction that it makes unilateral.

    More merges make more transactions unilateral and those more merges, so the
    rounds only add edges and end with the first that adds none.  A round looks
    at the transactions that are still open and clusters only what their edges touch.
    """
    plain = ledger.tx.select("tx_id").join(mixes.where("flag").select(F.col("key").alias("tx_id")), "tx_id", "left_anti")
    now = cut(cluster(multi_input_edges(ledger, plain)))
    left = change_edges(ledger, change).join(ledger.txout.select(F.col("out_id").alias("a"), "tx_id"), "a")
    left = cut(left.select("tx_id", "a", "b"))
    for _ in range(MAX_ROUNDS):
        alone = is_unilateral(ledger, now, left.select("tx_id").distinct()).where("flag").select(F.col("key").alias("tx_id"))
        alone = cut(alone)
        if alone.isEmpty():
            return now
        now = cut(grown(now, left.join(alone, "tx_id", "left_semi").select("a", "b")))
        left = cut(left.join(alone, "tx_id", "left_anti"))
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
