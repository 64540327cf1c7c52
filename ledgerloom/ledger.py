"""The ledger: four DataFrames that all operators take.

==========  ==============================================================
tx          tx_id, version, locktime, block_height, n_in, n_out
txin        in_id, tx_id, vin, prev_out_id, sequence [, script_sig, witness]
txout       out_id, tx_id, vout, value, spk, output_type
==========  ==============================================================

Ids are BIGINT.  An id of 0 or more is confirmed (dense), a negative one is
unconfirmed (loose); see ``functions.ids``.  prev_out_id is null where the
spent output is not part of the ledger.  Sequences and locktimes are unsigned
32-bit numbers and so BIGINT as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ledger:
    tx: DataFrame
    txin: DataFrame
    txout: DataFrame

    @cached_property
    def spent(self) -> DataFrame:
        """Each input with the output that it spends: prev_value, prev_spk, prev_type, prev_tx_id (null if unresolved)."""
        prev = self.txout.select(
            F.col("out_id").alias("prev_out_id"), F.col("value").alias("prev_value"), F.col("spk").alias("prev_spk"),
            F.col("output_type").alias("prev_type"), F.col("tx_id").alias("prev_tx_id"), F.col("vout").alias("prev_vout"),
        )
        return self.txin.join(prev, "prev_out_id", "left")

    def near(self, txs: DataFrame) -> Ledger:
        """The ledger of some transactions (tx_id), with the outputs that they spend besides their own."""
        ids = txs.select("tx_id").distinct()
        ins = self.txin.join(ids, "tx_id", "left_semi")
        spent = ins.where("prev_out_id IS NOT NULL").select(F.col("prev_out_id").alias("out_id")).distinct()
        outs = self.txout.join(ids, "tx_id", "left_semi").unionByName(self.txout.join(spent, "out_id", "left_semi").join(ids, "tx_id", "left_anti").select(*self.txout.columns))
        return Ledger(self.tx.join(ids, "tx_id", "left_semi"), ins, outs)

    def above(self, tx_id: int) -> Ledger:
        """The ledger of the transactions from tx_id on: outputs of older ones are unknown, so inputs that spend them are unresolved."""
        outs = self.txout.where(F.col("tx_id") >= tx_id)
        ins = self.txin.where(F.col("tx_id") >= tx_id)
        known = outs.select(F.col("out_id").alias("prev_out_id"), F.lit(True).alias("known"))
        ins = ins.join(known, "prev_out_id", "left").withColumn("prev_out_id", F.when(F.col("known"), F.col("prev_out_id"))).drop("known")
        return Ledger(self.tx.where(F.col("tx_id") >= tx_id), ins, outs)
