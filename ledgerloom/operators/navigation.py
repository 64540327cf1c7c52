"""Scans, and walks along the spend graph; each is a filter or one equi-join.

Sets are bags: DataFrames of one id column (tx_id or out_id), repeats kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import is_dense
from ledgerloom.ledger import Ledger


def dense_txs(tx: DataFrame) -> DataFrame:
    return tx.where(is_dense(F.col("tx_id"))).select("tx_id")


def loose_txs(tx: DataFrame) -> DataFrame:
    return tx.where(~is_dense(F.col("tx_id"))).select("tx_id")


def tip_window(tx: DataFrame, depth: int) -> DataFrame:
    """Transactions of the last depth + 1 blocks."""
    tip = tx.agg(F.max("block_height"))
    return tx.where(F.col("block_height") >= tip.scalar() - depth).select("tx_id", "block_height")


def outputs_of(txs: DataFrame, ledger: Ledger) -> DataFrame:
    return txs.join(ledger.txout.select("tx_id", "out_id", "vout"), "tx_id")


def inputs_of(txs: DataFrame, ledger: Ledger) -> DataFrame:
    return txs.join(ledger.txin.select("tx_id", "in_id", "vin"), "tx_id")


def txs_of(outs: DataFrame, ledger: Ledger) -> DataFrame:
    """One tx_id for each output, repeats kept."""
    return outs.join(ledger.txout.select("out_id", "tx_id"), "out_id").select("tx_id")


def spending(ledger: Ledger) -> DataFrame:
    """Each output with the input and transaction that spend it, or nulls; of several inputs the last one counts."""
    by_out = ledger.txin.where(F.col("prev_out_id").isNotNull()).groupBy(F.col("prev_out_id").alias("out_id"))
    spender = by_out.agg(F.max(F.struct("in_id", "tx_id")).alias("last")).select("out_id", F.col("last.in_id").alias("spender_in_id"), F.col("last.tx_id").alias("spender_tx_id"))
    return ledger.txout.join(spender, "out_id", "left")


def first_use(ledger: Ledger) -> DataFrame:
    """Each script's first output."""
    return ledger.txout.groupBy("spk").agg(F.min("out_id").alias("first_out_id"))


def linked(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (prev_txid, prev_vout) with the id of the output that they name, null where it is not known."""
    known = outputs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), F.col("out_id").alias("prev_out_id"))
    return inputs.join(known, ["prev_txid", "prev_vout"], "left")


def tx_ranges(tx: DataFrame) -> DataFrame:
    """(block_height, tx_start, tx_end) of consecutive transactions."""
    return tx.groupBy("block_height").agg(F.min("tx_id").alias("tx_start"), (F.max("tx_id") + 1).alias("tx_end"))


def value_sums(ledger: Ledger) -> DataFrame:
    """sum_in, min_in, n_resolved and sum_out, min_out, n_out of each transaction; unresolved inputs count for nothing."""
    ins = ledger.spent.where("prev_value IS NOT NULL").groupBy("tx_id").agg(F.sum("prev_value").alias("sum_in"), F.min("prev_value").alias("min_in"), F.count(F.lit(1)).alias("n_resolved"))
    outs = ledger.txout.groupBy("tx_id").agg(F.sum("value").alias("sum_out"), F.min("value").alias("min_out"), F.count(F.lit(1)).alias("n_outs"))
    both = ledger.tx.select("tx_id").join(ins, "tx_id", "left").join(outs, "tx_id", "left")
    return both.fillna(0, ["sum_in", "n_resolved", "sum_out", "n_outs"])


def filtered(items: DataFrame, predicate: Column) -> DataFrame:
    return items.where(predicate)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both bags, one after the other."""
    return left.unionByName(right)


def intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The items of the left bag that the right one has too, with their repeats."""
    return left.join(right.select(key), key, "left_semi")


def subtract(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The items of the left bag that the right one has not, with their repeats."""
    return left.join(right.select(key), key, "left_anti")


def assembled(txs: DataFrame, ledger: Ledger) -> DataFrame:
    """The whole transactions of a set: all columns of ``tx``, and lists of inputs and outputs in their order.

    Inputs have what they spend beside them, nulls where that is not known.
    """
    some = ledger.tx.join(txs.select("tx_id").distinct(), "tx_id", "left_semi")
    listed = lambda df, at: F.array_sort(F.collect_list(F.struct(at, *[c for c in df.columns if c not in ("tx_id", at)])))
    ins = ledger.spent.join(some.select("tx_id"), "tx_id", "left_semi")
    outs = ledger.txout.join(some.select("tx_id"), "tx_id", "left_semi")
    ins = ins.groupBy("tx_id").agg(listed(ins, "vin").alias("inputs"))
    outs = outs.groupBy("tx_id").agg(listed(outs, "vout").alias("outputs"))
    both = some.join(ins, "tx_id", "left").join(outs, "tx_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select(*some.columns, empty("inputs"), empty("outputs"))
