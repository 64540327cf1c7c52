"""Transactions, blocks and headers as bytes, from the tables of a ledger."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.arrow import mapped
from ledgerloom.checkpoints import folder, removed, stored
from ledgerloom.ledger import Ledger

MAX_ROUNDS = 10_000
#: Headers that are broadcast, at most (100 MB); blocks of more are dealt by their heights.
FEW_HEADERS = 1 << 20
#: The outpoint and sequence of an input that spends nothing.
NO_TXID, NO_VOUT = "00" * 32, 0xFFFFFFFF


def little(n: Column, size: int) -> Column:
    """A number as so many bytes in hexadecimal, the lowest first."""
    code = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(code, 2 * k + 1, 2) for k in reversed(range(size))])


def compact(n: Column) -> Column:
    """A count in 1, 3 or 5 bytes in hexadecimal."""
    return F.when(n < 0xFD, little(n, 1)).when(n <= 0xFFFF, F.concat(F.lit("FD"), little(n, 2))).otherwise(F.concat(F.lit("FE"), little(n, 4)))


def _sized(data: Column) -> Column:
    return F.concat(compact(F.octet_length(data)), F.hex(data))


def sha256d(data: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(F.sha2(data, 256)), 256))


def _listed(df: DataFrame, at: str, code: Column, name: str) -> DataFrame:
    return df.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct(at, code.alias("code")))).alias(name))


def _body(c: str) -> Column:
    return F.concat(compact(F.size(c)), F.array_join(F.transform(c, lambda x: F.hex(x["code"])), ""))


def transactions(ledger: Ledger) -> DataFrame:
    """(tx_id, block_height, txid, raw) of each transaction; spk is binary, witnesses are not written.

    A transaction's bytes name those of its parents, so they are made generation
    by generation, one round of joins each, that is kept as a table.  An input whose output is not part of
    the ledger names ``outpoint_txid`` and ``outpoint_vout``, where the ledger has them, else a digest
    of its own; a transaction without inputs gets one that spends nothing and
    holds its id, so that no two are the same.
    """
    own = "outpoint_txid" in ledger.txin.columns
    script = "script_sig" in ledger.txin.columns
    lone = F.coalesce("outpoint_txid", F.unhex(F.sha2(F.col("in_id").cast("string"), 256))) if own else F.unhex(F.sha2(F.col("in_id").cast("string"), 256))
    ins = ledger.spent.select("tx_id", "vin", "sequence", "prev_tx_id", F.when(F.col("prev_tx_id").isNull(), lone).alias("lone"), F.coalesce("prev_vout", "outpoint_vout" if own else F.lit(0)).alias("at"), (F.coalesce("script_sig", F.lit(b"")) if script else F.lit(b"")).alias("script_sig"))
    spark, used = ledger.tx.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        table, path = stored(df)
        used.append(path)
        return table

    outs = kept(_listed(ledger.txout, "vout", F.unhex(F.concat(little(F.col("value"), 8), _sized(F.col("spk")))), "o"))
    version = F.col("version") if "version" in ledger.tx.columns else F.lit(2)
    tx = kept(ledger.tx.select("tx_id", "block_height", "locktime", version.alias("version")))
    ins = kept(ins)
    none = F.concat(F.lit("01" + NO_TXID), little(F.lit(NO_VOUT), 4), F.lit("08"), little(F.col("tx_id"), 8), little(F.lit(NO_VOUT), 4))
    parents = kept(ins.where("prev_tx_id IS NOT NULL").select("tx_id", "prev_tx_id").distinct().join(tx.select(F.col("tx_id").alias("prev_tx_id")), "prev_tx_id", "left_semi"))
    target = f"{folder(spark.sparkContext)}/made-{uuid.uuid4().hex}"
    left, known = tx, None
    for k in range(MAX_ROUNDS):
        waits = parents if known is None else parents.join(known, "prev_tx_id", "left_anti")
        ready = left.join(waits.select("tx_id").distinct(), "tx_id", "left_anti")
        some = ins.join(ready.select("tx_id"), "tx_id", "left_semi")
        some = some.withColumn("parent", F.lit(None).cast("binary")) if known is None else some.join(known, "prev_tx_id", "left")
        code = F.unhex(F.concat(F.hex(F.coalesce("parent", "lone")), little(F.col("at"), 4), _sized(F.col("script_sig")), little(F.col("sequence"), 4)))
        both = ready.join(_listed(some, "vin", code, "i"), "tx_id", "left").join(outs, "tx_id", "left")
        raw = F.unhex(F.concat(little(F.col("version"), 4), F.coalesce(_body("i"), none), F.coalesce(_body("o"), F.lit("00")), little(F.col("locktime"), 4)))
        new = both.select("tx_id", "block_height", raw.alias("raw")).select("tx_id", "block_height", sha256d(F.col("raw")).alias("txid"), "raw")
        new.write.parquet(f"{target}/generation={k}")
        made = spark.read.schema(new.schema).option("recursiveFileLookup", "true").parquet(target)
        known = made.select(F.col("tx_id").alias("prev_tx_id"), F.col("txid").alias("parent"))
        left = tx.join(made.select("tx_id"), "tx_id", "left_anti")
        if left.isEmpty():
            for path in used:
                removed(spark, path)
            return made
    raise RuntimeError(f"a chain of more than {MAX_ROUNDS} transactions")


def headers(roots: DataFrame) -> DataFrame:
    """(height, header) of 80 bytes for each (height, root): each names the one before it, so they are made in a row, in the order of heights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = bytes(32)
        for batch in batches:
            made = []
            for height, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.append((1).to_bytes(4, "little") + prev + root + (height & 0xFFFFFFFF).to_bytes(4, "little") + bytes(8))
                prev = hashlib.sha256(hashlib.sha256(made[-1]).digest()).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["height", "header"])

    # in one task by nature, over 40 bytes a block
    return mapped(roots.select("height", "root").coalesce(1).sortWithinPartitions("height"), task, "height long, header binary")


def blocks(txs: DataFrame) -> DataFrame:
    """(height, n_tx, header, block) of ``transactions``; a block's are put together in the order of their ids."""
    by = txs.groupBy(F.col("block_height").alias("height")).agg(F.array_sort(F.collect_list(F.struct("tx_id", "txid", "raw"))).alias("t"))
    joined = lambda part: F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x[part])), ""))
    bodies, _ = stored(by.select("height", F.size("t").alias("n_tx"), sha256d(joined("txid")).alias("root"), joined("raw").alias("body")))
    made = bodies.join(F.broadcast(headers(bodies)) if bodies.count() <= FEW_HEADERS else headers(bodies), "height")
    return made.select("height", "n_tx", "header", F.concat("header", F.unhex(compact(F.col("n_tx"))), "body").alias("block"))
