"""Facts of transactions as keyed state: their parts come as a stream, in any order, and what is known of each so far is kept.

A transaction's row, its outputs and its inputs come one by one, in any batch.
The state's key is a run of ``RUN`` transaction ids, so that what is asked of the
state store in a batch, a message between Python and the JVM each time, is asked once for them all. For a run the state holds

* a value: what the parts of each of its transactions have come to (``_Seen``), pickled together; with it, while a
  transaction is not complete and not known as a mix, how often each amount stands among its outputs.

What a sequence means depends on the locktime, which may come later; so it is kept whether one was relative.

Only the transactions that a batch touches are told.  One that has
all the parts that its row names is complete; its amounts are cleared and
parts that come again are not counted.  A timer ends the state of a transaction
once the watermark has passed the time of its first part by ``wait``: one that is
still incomplete then is told a last time, as expired.  Without event time the clock takes
its place, and the state can be given a time to live besides; then each transaction is a run by itself, since a run lives as long as any of it.

State is held by RocksDB and kept in the stream's checkpoint, so a restart goes
on behind the last batch that was written.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.functions.scalars import RBF_BELOW, RELATIVE_BELOW
from ledgerloom.ledger import Ledger
from ledgerloom.operators.heuristics import EQUAL_OUTPUTS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Kinds of parts: a transaction's row (n_in, n_out, locktime), an output (amount), an input (amount is its sequence), and a sign of time alone.
ROW, OUT, IN, TICK = 0, 1, 2, 3
PART = "tx_id long, at timestamp, kind int, amount long, n_in long, n_out long, locktime long"
FACTS = "key long, n_in long, n_out long, total long, rbf boolean, coinjoin boolean, bip68_with_locktime boolean, complete boolean, expired boolean"

#: What is known of a transaction; until: the time at which its state ends.
_Seen = tuple[int, int, int | None, int | None, int | None, int, int, int, bool, bool, bool, dict[int, int], bool]  # tx_id, until, want_in, want_out, locktime, n_in, n_out, total, rbf, mix, relative, amounts, complete
#: In the place of nulls of a part, so that a column stays one of whole numbers.
_NONE = -(1 << 63)
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
_COLUMNS = ("tx_id", "kind", "amount", "n_in", "n_out", "locktime", "at_ms")
#: Transaction ids that share a state.
RUN = 64
#: Transactions a part of the state, at most.
PART_TXS = 1 << 19


def parts(ledger: Ledger, at) -> DataFrame:  # noqa: ANN001
    """The parts of a ledger's transactions; at: the time of a transaction, from the columns of ``tx``."""
    n = lambda df, name: df.groupBy("tx_id").agg(F.count(F.lit(1)).alias(name))
    none = F.lit(None).cast("long")
    tx = ledger.tx.select("tx_id", at.cast("timestamp").alias("at"), F.col("locktime").cast("long").alias("locktime"))
    rows = tx.join(n(ledger.txin, "n_in"), "tx_id", "left").join(n(ledger.txout, "n_out"), "tx_id", "left").fillna(0, ["n_in", "n_out"])
    rows = rows.select("tx_id", "at", F.lit(ROW).alias("kind"), none.alias("amount"), "n_in", "n_out", "locktime")
    some = lambda df, kind, c: df.join(tx.select("tx_id", "at"), "tx_id").select("tx_id", "at", F.lit(kind).alias("kind"), F.col(c).alias("amount"), none.alias("n_in"), none.alias("n_out"), none.alias("locktime"))
    return rows.unionByName(some(ledger.txout, OUT, "value")).unionByName(some(ledger.txin, IN, "sequence"))


class _Facts(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int | None, event_time: bool) -> None:
        self.wait_ms, self.keep_ms, self.event_time = wait_ms, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "txs binary", self.keep_ms)

    def _held(self) -> list[_Seen]:
        held = self.seen.get()
        return pickle.loads(bytes(held[0])) if held else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came: dict[int, list[tuple]] = {}
        for some in rows:
            for tx_id, *part in zip(*(some[c].tolist() for c in _COLUMNS), strict=True):
                if part[0] != TICK:
                    came.setdefault(tx_id, []).append(part)
        if not came:
            return
        held = {s[0]: s for s in self._held()}
        timers = {s[1] for s in held.values()}
        told = []
        for tx_id, parts in came.items():
            old = held.get(tx_id)
            if old is None or not old[-1]:
                held[tx_id] = self._with(tx_id, old, parts, timerValues)
                told.append(held[tx_id])
        if not told:
            return
        for until in {s[1] for s in told} - timers:
            self.handle.registerTimer(until)
        self.seen.update((pickle.dumps(list(held.values())),))
        yield self._told(told, False)

    def _with(self, tx_id: int, old: _Seen | None, parts: list[list], timerValues) -> _Seen:  # noqa: ANN001, N803
        """What is known of a transaction with more parts of it."""
        _, until, want_in, want_out, locktime, n_in, n_out, total, rbf, mix, relative, values, _ = old or (tx_id, None, None, None, None, 0, 0, 0, False, False, False, {}, False)
        for kind, amount, wants_in, wants_out, lock, _ in parts:
            if kind == ROW:
                want_in, want_out, locktime = (None if n == _NONE else n for n in (wants_in, wants_out, lock))
            elif kind == OUT:
                n_out, total = n_out + 1, total + amount
                values[amount] = values.get(amount, 0) + 1
            else:
                n_in, rbf, relative = n_in + 1, rbf or amount < RBF_BELOW, relative or amount < RELATIVE_BELOW
        complete = locktime is not None and (n_in, n_out) == (want_in, want_out)
        mix = mix or any(n >= EQUAL_OUTPUTS for n in values.values())
        if until is None:
            until = self.wait_ms + (min(p[-1] for p in parts) if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        return tx_id, until, want_in, want_out, locktime, n_in, n_out, total, rbf, mix, relative, {} if mix or complete else values, complete

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        left = [s for s in held if s[1] > now]
        if left:
            self.seen.update((pickle.dumps(left),))
        else:
            self.seen.clear()
        if ended := [s for s in held if s[1] <= now and not s[-1]]:
            yield self._told(ended, True)

    def _told(self, states: list[_Seen], expired: bool) -> pd.DataFrame:
        rows = [(tx_id, n_in, n_out, total, rbf, mix, relative and (locktime or 0) > 0, complete, expired) for tx_id, _, _, _, locktime, n_in, n_out, total, rbf, mix, relative, _, complete in states]
        return pd.DataFrame(dict(zip(_NAMES, zip(*rows, strict=True), strict=True)))

    def close(self) -> None: ...


def facts(stream: DataFrame, wait_ms: int, late: str | None = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """FACTS of each transaction that a batch of parts (``PART``) touches, or whose time has come.

    late: how much later than others a part may come; None: time is the clock's, and keep_ms the state's time to live.
    """
    if late is not None and keep_ms is not None:
        raise ValueError("a time to live goes by the clock; with event time, wait_ms ends the state")
    timed, mode = (stream, "ProcessingTime") if late is None else (stream.withWatermark("at", late), "EventTime")
    whole = lambda c: F.coalesce(c, F.lit(_NONE)).alias(c)
    run = F.coalesce(F.floor(F.col("tx_id") / (RUN if late is not None else 1)), F.lit(_NONE)).alias("run")
    timed = timed.select(run, *[whole(c) for c in ("tx_id", "amount", "n_in", "n_out", "locktime")], "kind", F.unix_millis("at").alias("at_ms"), *(["at"] if late is not None else []))
    return timed.groupBy("run").transformWithStateInPandas(_Facts(wait_ms, keep_ms, late is not None), FACTS, "Update", mode)


def partitions(ledger: Ledger) -> int:
    """Parts of the state of a ledger's facts: each is opened, written and committed in each batch, so there are as many as tasks run at once, or more of ``PART_TXS`` transactions."""
    return max(ledger.tx.sparkSession.sparkContext.defaultParallelism, -(-ledger.tx.count() // PART_TXS))


@contextmanager
def rocks(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that begin here hold their state by RocksDB, in so many parts if they are new."""
    wanted = {_PROVIDER: ROCKS} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def maintain(told: DataFrame, folder: str, checkpoint: str, clock: bool = False, partitions: int | None = None) -> StreamingQuery:
    """Keeps what ``facts`` tells: a table for each batch, which holds the keys that it touched and no other.

    Ends when all that is there now is read; by the clock, whose timers may always have more to tell, after one batch of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("fact", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/fact={number:012d}")

    with rocks(told.sparkSession, partitions):
        return told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**({"once": True} if clock else {"availableNow": True})).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """FACTS as they were told last; the time of a transaction may come in the batch in which it is told as complete."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("key", "fact")]), F.struct("fact", "expired")).alias("last")
    return rows.groupBy("key").agg(last).select("key", "last.*")


def mask(spark: SparkSession, folder: str, flag: str) -> DataFrame:
    """One of the flags (rbf, coinjoin, bip68_with_locktime) as a mask."""
    return latest(spark, folder).select("key", F.col(flag).alias("flag"))
