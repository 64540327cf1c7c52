"""Ledgers as tables in versions, sinks of ledgers, ledgers made by hand, and ledgers put together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.ids import loose_out
from ledgerloom.functions.scripts import output_type
from ledgerloom.ledger import Ledger
from ledgerloom.sources.versions import Versioned

#: Blocks whose rows share a folder.
BUCKET = 1000


KEYS = {"tx": "tx_id", "txin": "in_id", "txout": "out_id"}


def _bucket() -> Column:
    return F.coalesce(F.floor(F.col("block_height") / BUCKET), F.lit(-1)).cast("long").alias("bucket")


def _bucketed(ledger: Ledger, name: str) -> DataFrame:
    df: DataFrame = getattr(ledger, name)
    if name == "tx":
        return df.withColumn("bucket", _bucket())
    if "block_height" in df.columns:  # nothing has to be looked up
        return df.withColumn("bucket", _bucket()).drop("block_height")
    return df.join(ledger.tx.select("tx_id", _bucket()), "tx_id")


class Sink:
    """What takes a ledger in: one call for each table, whole, and one at the end with the heights that it brought.

    A sink of one's own overrides what it needs.
    """

    def on_transactions(self, tx: DataFrame) -> None: ...

    def on_inputs(self, txin: DataFrame) -> None: ...

    def on_outputs(self, txout: DataFrame) -> None: ...

    def on_blocks_end(self, heights: DataFrame) -> None: ...


def feed(ledger: Ledger, *sinks: Sink) -> None:
    """Hands the ledger to the sinks: transactions, outputs, inputs, then the end of its blocks."""
    for sink in sinks:
        sink.on_transactions(_bucketed(ledger, "tx"))
        sink.on_outputs(_bucketed(ledger, "txout"))
        sink.on_inputs(_bucketed(ledger, "txin"))
        sink.on_blocks_end(ledger.tx.select("block_height").where("block_height IS NOT NULL").distinct())


class Tables(Sink):
    """Tables in versions below a folder, each row in the part of its transaction's block, so that height ranges are read alone."""

    def __init__(self, folder: str, overwrite: bool = False) -> None:
        self.folder, self.overwrite = folder, overwrite

    def _write(self, df: DataFrame, name: str) -> None:
        at = table(df.sparkSession, self.folder, name)
        at.overwrite(df) if self.overwrite else at.append(df)

    def on_transactions(self, tx: DataFrame) -> None:
        self._write(tx, "tx")

    def on_inputs(self, txin: DataFrame) -> None:
        self._write(txin, "txin")

    def on_outputs(self, txout: DataFrame) -> None:
        self._write(txout, "txout")


def table(spark: SparkSession, folder: str, name: str) -> Versioned:
    """A stored table (tx, txin or txout) with its versions."""
    return Versioned(spark, f"{folder}/{name}", "bucket")


def save(ledger: Ledger, folder: str) -> None:
    """Writes the tables anew."""
    feed(ledger, Tables(folder, overwrite=True))


def append(ledger: Ledger, folder: str) -> None:
    """Adds a ledger's rows to the tables; their ids have to be new."""
    feed(ledger, Tables(folder))


def get(spark: SparkSession, folder: str, name: str, ids: DataFrame) -> DataFrame:
    """The rows of a table (tx, txin or txout) with the given ids, a column of the table's key."""
    return table(spark, folder, name).rows().drop("bucket").join(ids.select(KEYS[name]).distinct(), KEYS[name], "left_semi")


def put(rows: DataFrame, folder: str, name: str) -> None:
    """Puts rows, whole ones of a table with their bucket, in the place of those with the same key; only their buckets are written.

    Who reads meanwhile reads the version before.
    """
    table(rows.sparkSession, folder, name).put(rows, KEYS[name])


def load(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> Ledger:
    """The saved ledger, or its blocks from low to high; inputs that spend what lies outside are unresolved."""
    first, last = None if low is None else low // BUCKET, None if high is None else high // BUCKET
    whole = Ledger(**{name: table(spark, folder, name).rows(None, first, last).drop("bucket") for name in ("tx", "txin", "txout")})
    if low is None and high is None:
        return whole
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("block_height") >= low)
    if high is not None:
        inside = inside & (F.col("block_height") <= high)
    return part(whole, whole.tx.where(inside))


def part(ledger: Ledger, tx: DataFrame) -> Ledger:
    """The ledger of some of its transactions."""
    ids = tx.select("tx_id")
    outs = ledger.txout.join(ids, "tx_id", "left_semi")
    known = outs.select(F.col("out_id").alias("prev_out_id"), F.lit(True).alias("known"))
    ins = ledger.txin.join(ids, "tx_id", "left_semi").join(known, "prev_out_id", "left")
    return Ledger(tx, ins.withColumn("prev_out_id", F.when(F.col("known"), F.col("prev_out_id"))).drop("known"), outs)


def together(dense: Ledger, loose: Ledger) -> Ledger:
    """Confirmed and unconfirmed transactions as one ledger; their ids differ by their sign."""
    return Ledger(*(getattr(dense, n).unionByName(getattr(loose, n), allowMissingColumns=True) for n in ("tx", "txin", "txout")))


@dataclass
class Builder:
    """Unconfirmed transactions one after the other: keys are 1, 2, .. and ids negative."""

    tx: list[tuple] = field(default_factory=list)
    ins: list[tuple] = field(default_factory=list)
    outs: list[tuple] = field(default_factory=list)

    def add(self, values: list[int], spends: list[tuple[int, int]] = (), locktime: int = 0, sequence: int = 0, version: int = 2, spk: bytes = b"\x76\xa9\x14" + bytes(20) + b"\x88\xac") -> int:
        """A transaction with outputs of these values that spends (key, vout), of later keys too; its key."""
        key = len(self.tx) + 1
        self.tx.append((key, version, locktime))
        self.outs += [(key, v, value, spk) for v, value in enumerate(values)]
        self.ins += [(key, v, a, b, sequence) for v, (a, b) in enumerate(spends)]
        return key

    def ledger(self, spark: SparkSession) -> Ledger:
        tx = spark.createDataFrame(self.tx, "key long, version int, locktime long")
        outs = spark.createDataFrame(self.outs, "key long, vout long, value long, spk binary")
        ins = spark.createDataFrame(self.ins, "key long, vin long, prev_key long, prev_vout long, sequence long")
        outs = outs.select(loose_out(F.col("key"), F.col("vout")).alias("out_id"), (-F.col("key")).alias("tx_id"), "vout", "value", "spk", output_type(F.col("spk")).alias("output_type"))
        ins = ins.select(loose_out(F.col("key"), F.col("vin")).alias("in_id"), (-F.col("key")).alias("tx_id"), "vin", loose_out(F.col("prev_key"), F.col("prev_vout")).alias("prev_out_id"), "sequence")
        return part(Ledger(tx, ins, outs), tx.select((-F.col("key")).alias("tx_id"), "version", "locktime", F.lit(None).cast("long").alias("block_height")))
