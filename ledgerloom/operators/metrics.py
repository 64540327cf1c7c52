"""Metrics of a ledger's coins, fees, blocks and payments, as grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut, stored
from ledgerloom.functions.scripts import is_spendable
from ledgerloom.ledger import Ledger
from ledgerloom.operators.ordinals import RANGE, nearest
from ledgerloom.simulator.config import WEIGHTS

#: Amounts up to which an output is dust, and the weight units of a transaction without inputs and outputs, and of a witness flag.
DUST, BASE_WEIGHT, WITNESS_WEIGHT = 546, 40, 2
#: Amounts whose distances are broadcast, at most (16 bytes each); more are joined by a shuffle.
FEW_AMOUNTS = 1 << 20


def utxo_set(ledger: Ledger) -> DataFrame:
    """Outputs that no input spends."""
    spends = ledger.txin.where("prev_out_id IS NOT NULL").select(F.col("prev_out_id").alias("out_id"))
    return ledger.txout.join(spends, "out_id", "left_anti")


def dust_count(utxos: DataFrame) -> DataFrame:
    return utxos.agg(F.count_if(F.col("value") <= DUST).alias("n_dust"), F.count(F.lit(1)).alias("n_utxos"))


def utxo_sizes(utxos: DataFrame) -> DataFrame:
    """How many unspent outputs there are of each amount."""
    return utxos.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def wallet_stats(utxos: DataFrame, wallet: str) -> DataFrame:
    """Dust, number, and nearest-rank percentiles of each wallet's unspent outputs.

    The percentiles are taken from counts by amount in two levels, ranges of
    amounts and then amounts within one, so that neither a wallet's coins nor
    all its amounts come together in one task.
    """
    counts = utxos.groupBy(wallet, "value").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("value") / RANGE))
    ranges = counts.groupBy(wallet, "range").agg(F.sum("n").alias("m"))
    before = ranges.withColumn("before", F.sum("m").over(Window.partitionBy(wallet).orderBy("range")) - F.col("m")).drop("m")
    totals = counts.groupBy(wallet).agg(F.sum("n").alias("n_utxos"), F.sum(F.when(F.col("value") <= DUST, F.col("n")).otherwise(0)).alias("n_dust"))
    ranked = counts.join(before, [wallet, "range"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(wallet, "range").orderBy("value")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("n_utxos")), F.lit(1)), F.col("value")))
    return ranked.join(totals, wallet).groupBy(wallet, "n_utxos", "n_dust").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


def _weight(type_: Column, place: int) -> Column:
    """Weight units by the output type's number; types without a prediction count as taproot."""
    p2pkh, p2wpkh, p2tr = (WEIGHTS[k][place] for k in ("p2pkh", "p2wpkh", "p2tr"))
    return F.when(type_ == 0, p2pkh).when(type_ == 2, p2wpkh).otherwise(p2tr)


def fees_and_weights(ledger: Ledger) -> DataFrame:
    """fee (0 without inputs; null where outputs exceed inputs) and predicted weight of each transaction."""
    ins = ledger.spent.groupBy("tx_id").agg(
        F.sum("prev_value").alias("sum_in"), F.sum(_weight(F.col("prev_type"), 0)).alias("w_in"), F.bool_or(F.col("prev_type") != 0).alias("witness")
    )
    outs = ledger.txout.groupBy("tx_id").agg(F.sum("value").alias("sum_out"), F.sum(_weight(F.col("output_type"), 1)).alias("w_out"))
    both = ledger.tx.select("tx_id", "block_height").join(ins, "tx_id", "left").join(outs, "tx_id", "left").fillna(0, ["w_in", "w_out", "sum_out"])
    fee = F.when(F.col("sum_in").isNull(), F.lit(0).cast("long")).when(F.col("sum_in") >= F.col("sum_out"), F.col("sum_in") - F.col("sum_out"))
    weight = F.lit(BASE_WEIGHT) + F.when(F.coalesce("witness", F.lit(False)), WITNESS_WEIGHT).otherwise(0) + F.col("w_in") + F.col("w_out")
    return both.select("tx_id", "block_height", F.col("sum_in").isNull().alias("is_coinbase"), fee.alias("fee"), weight.cast("long").alias("weight"))


def block_weights(sized: DataFrame) -> DataFrame:
    return sized.groupBy("block_height").agg(F.sum("weight").alias("weight"))


def average_fee(sized: DataFrame) -> DataFrame:
    """Whole part of the mean fee of transactions with inputs, 0 without any."""
    paid = sized.where("NOT is_coinbase AND fee IS NOT NULL")
    return paid.agg(F.coalesce(F.expr("sum(fee) div count(fee)"), F.lit(0).cast("long")).alias("average_fee"))


def summary(obligations: DataFrame, handled: DataFrame) -> DataFrame:
    """How many obligations there are, how many are missed, and their share (0 without any)."""
    left = missed(obligations, handled).agg(F.coalesce(F.sum("n_missed"), F.lit(0)).cast("long").alias("n_missed"))
    both = obligations.agg(F.count(F.lit(1)).alias("n_obligations")).withColumn("n_missed", left.scalar())
    return both.withColumn("share_missed", F.when(F.col("n_obligations") > 0, F.col("n_missed") / F.col("n_obligations")).otherwise(0.0))


def missed(obligations: DataFrame, handled: DataFrame) -> DataFrame:
    """Obligations of each payer that are not handled."""
    return obligations.join(handled, "obligation_id", "left_anti").groupBy("payer").agg(F.count(F.lit(1)).alias("n_missed"))


def unhandled(obligations: DataFrame, handled: DataFrame, pending: DataFrame, now: int) -> DataFrame:
    """Obligations that are revealed, not handled, and not paid by a pending transaction."""
    return obligations.where(F.col("reveal") <= now).join(handled, "obligation_id", "left_anti").join(pending, "obligation_id", "left_anti")


def order_book(registered: DataFrame, confirmed: DataFrame, spending: DataFrame) -> DataFrame:
    """Registered coins that are confirmed and not being spent (out_id); confirmed: outputs (out_id), or transactions (tx_id) where it has no such column."""
    key = "out_id" if "out_id" in confirmed.columns else "tx_id"
    return registered.join(confirmed.select(key), key, "left_semi").join(spending.select("out_id"), "out_id", "left_anti")


def cospend_ranking(book: DataFrame, reference: DataFrame, limit: int | None = None) -> DataFrame:
    """Coins of the book with their least distance to an amount of the reference set, or the largest number without any.

    With a limit only the first so many by (distance, tx_id, vout), in that
    order; without one the order is for the reader to make.
    """
    book, _ = stored(book.select("out_id", "tx_id", "vout", "value"))  # read twice, and its joins made once
    known = cut(nearest(book.select("value"), reference.select("value")))
    few = known.limit(FEW_AMOUNTS + 1).count() <= FEW_AMOUNTS
    far = F.coalesce("distance", F.lit(0x7FFFFFFFFFFFFFFF)).alias("distance")
    ranked = book.join(F.broadcast(known) if few else known, "value", "left").select("out_id", "tx_id", "vout", far)
    return ranked if limit is None else ranked.orderBy("distance", "tx_id", "vout").limit(limit)


def feerates(sized: DataFrame) -> DataFrame:
    """``sized`` with the fee for each weight unit; null where the fee is."""
    return sized.withColumn("feerate", F.col("fee") / F.col("weight"))


def conflicts(pending: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Transactions of pending inputs (tx_id, prev_out_id) that spend what a confirmed input spends too, or another pending one."""
    gone = pending.join(confirmed.select("prev_out_id").distinct(), "prev_out_id", "left_semi").select("tx_id")
    rivals = pending.where("prev_out_id IS NOT NULL").groupBy("prev_out_id").agg(F.min("tx_id").alias("lo"), F.max("tx_id").alias("hi")).where("lo <> hi").select("prev_out_id")
    return gone.union(pending.join(rivals, "prev_out_id", "left_semi").select("tx_id")).distinct()


def wallet_deltas(ledger: Ledger, wallets: DataFrame) -> DataFrame:
    """(tx_id, wallet_id, received, spent) of each transaction and wallet that it touches; wallets: out_id, wallet_id.

    received: of its outputs to a wallet that spends none of its inputs, as change is no receipt.
    """
    outs = ledger.txout.select("tx_id", "out_id", "value").join(wallets, "out_id").groupBy("tx_id", "wallet_id").agg(F.sum("value").alias("got"))
    ins = ledger.spent.select("tx_id", F.col("prev_out_id").alias("out_id"), F.col("prev_value").alias("value")).join(wallets, "out_id").groupBy("tx_id", "wallet_id").agg(F.sum("value").alias("spent"))
    both = outs.join(ins, ["tx_id", "wallet_id"], "full")
    return both.select("tx_id", "wallet_id", F.when(F.col("spent").isNull(), F.col("got")).otherwise(0).cast("long").alias("received"), F.coalesce("spent", F.lit(0)).cast("long").alias("spent"))


def wallet_balance(utxos: DataFrame, wallet: str, pending_spends: DataFrame) -> DataFrame:
    """Unspent amounts of each wallet without what pending transactions spend."""
    return utxos.join(pending_spends.select("out_id"), "out_id", "left_anti").groupBy(wallet).agg(F.sum("value").alias("balance"), F.count(F.lit(1)).alias("n_coins"))


def double_spends(ledger: Ledger) -> DataFrame:
    """Outputs that more than one input spends; none in a valid ledger."""
    return ledger.txin.where("prev_out_id IS NOT NULL").groupBy("prev_out_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(ledger: Ledger) -> DataFrame:
    """(rule, n_violations) of a ledger's rules.

    No output is spent twice, none by a transaction before its own, none that
    is unspendable; and no transaction whose inputs are all known makes more than it spends.
    """
    later = ledger.spent.where("prev_tx_id >= 0 AND tx_id >= 0 AND prev_tx_id > tx_id")
    sums = ledger.spent.groupBy("tx_id").agg(F.sum("prev_value").alias("spent"), F.count_if(F.col("prev_value").isNull()).alias("unknown")).where("unknown = 0")
    more = ledger.txout.groupBy("tx_id").agg(F.sum("value").alias("made")).join(sums, "tx_id").where("made > spent")
    rules = {"double_spend": double_spends(ledger), "spends_later": later, "unspendable": ledger.spent.where(~is_spendable(F.col("prev_type"))), "creates_value": more}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n_violations")) for rule, df in rules.items()])
