"""Per-transaction heuristics as masks and columns.

Each is one or two keyed aggregations with map-side sums; none gathers a
transaction's rows unless the result is a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.arrow import mapped
from ledgerloom.functions import rawtx
from ledgerloom.functions.scalars import relative_locktime, signals_rbf
from ledgerloom.functions.scripts import is_spendable
from ledgerloom.ledger import Ledger
from ledgerloom.operators.navigation import value_sums

#: Equal outputs that make a mix, and the amount that round fees are whole multiples of.
EQUAL_OUTPUTS = 3
ROUND = 1000
SCRIPT_FINGERPRINTS = ("low_r", "uncompressed", "taproot_sighash")


def is_coinjoin(ledger: Ledger) -> DataFrame:
    """Transactions with some value on three outputs or more (of any type); those without outputs are false."""
    equal = ledger.txout.groupBy("tx_id", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("tx_id").agg((F.max("n") >= EQUAL_OUTPUTS).alias("flag"))
    return ledger.tx.select("tx_id").join(equal, "tx_id", "left").select(F.col("tx_id").alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"))


def coinbase_flags(ledger: Ledger) -> DataFrame:
    """What may say that a transaction is a coinbase: it has no inputs, its first input is unresolved, or (where the ledger keeps it) is_coinbase."""
    first = ledger.txin.where("vin = 0").select("tx_id", F.lit(True).alias("has"), "prev_out_id")
    own = ["is_coinbase"] if "is_coinbase" in ledger.tx.columns else []
    without, open_ = F.col("has").isNull().alias("without_inputs"), (F.col("has").isNotNull() & F.col("prev_out_id").isNull()).alias("unresolved_first")
    return ledger.tx.select("tx_id", *own).join(first, "tx_id", "left").select("tx_id", without, open_, *own)


def rbf_mask(ledger: Ledger) -> DataFrame:
    """Transactions with an input that signals replacement."""
    any_ = ledger.txin.groupBy("tx_id").agg(F.bool_or(signals_rbf(F.col("sequence"))).alias("flag"))
    return ledger.tx.select("tx_id").join(any_, "tx_id", "left").select(F.col("tx_id").alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"))


def rbf_share(ledger: Ledger) -> DataFrame:
    n, all_ = F.count_if("flag"), F.count(F.lit(1))
    return rbf_mask(ledger).agg(n.alias("n_rbf"), all_.alias("n_txs"), F.when(all_ > 0, n * 100.0 / all_).otherwise(0.0).alias("percent"))


def uih1(ledger: Ledger) -> DataFrame:
    """Outputs that are spendable and of less value than each resolved input of their transaction."""
    least = ledger.spent.where("prev_value IS NOT NULL").groupBy("tx_id").agg(F.min("prev_value").alias("min_in"))
    flag = is_spendable(F.col("output_type")) & F.coalesce(F.col("value") < F.col("min_in"), F.lit(False))
    return ledger.txout.join(least, "tx_id", "left").select(F.col("out_id").alias("key"), flag.alias("flag"))


def uih2(ledger: Ledger) -> DataFrame:
    """Transactions that would do without their smallest input: sum_in - min_in >= sum_out - min_out, with two resolved inputs or more."""
    flag = (F.col("n_resolved") >= 2) & (F.col("n_outs") >= 1) & (F.col("sum_in") - F.col("min_in") >= F.col("sum_out") - F.col("min_out"))
    return value_sums(ledger).select(F.col("tx_id").alias("key"), F.coalesce(flag, F.lit(False)).alias("flag"))


def mixed_input_types(ledger: Ledger) -> DataFrame:
    """Transactions whose inputs spend outputs of more than one type."""
    types = ledger.spent.where("prev_type IS NOT NULL").groupBy("tx_id").agg((F.min("prev_type") < F.max("prev_type")).alias("flag"))
    return ledger.tx.select("tx_id").join(types, "tx_id", "left").select(F.col("tx_id").alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"))


def address_reuse(ledger: Ledger) -> DataFrame:
    """Transactions that pay a script which one of their inputs had."""
    ins = ledger.spent.where("prev_spk IS NOT NULL").select("tx_id", F.col("prev_spk").alias("spk"))
    hit = ledger.txout.select("tx_id", "spk").join(ins, ["tx_id", "spk"], "left_semi").select("tx_id").distinct().withColumn("flag", F.lit(True))
    return ledger.tx.select("tx_id").join(hit, "tx_id", "left").select(F.col("tx_id").alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"))


def round_fee(ledger: Ledger) -> DataFrame:
    """fee and round_fee of each transaction, null where outputs exceed inputs."""
    fee = F.when(F.col("sum_in") >= F.col("sum_out"), F.col("sum_in") - F.col("sum_out"))
    return value_sums(ledger).select("tx_id", fee.alias("fee"), ((fee > 0) & (fee % ROUND == 0)).alias("round_fee"))


def output_structure(ledger: Ledger) -> DataFrame:
    """0 for a single output, 1 for two, 2 else (none too)."""
    n = F.coalesce("n", F.lit(0))
    counts = ledger.txout.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"))
    return ledger.tx.select("tx_id").join(counts, "tx_id", "left").select("tx_id", F.when(n == 1, 0).when(n == 2, 1).otherwise(2).alias("structure"))


def naive_change(ledger: Ledger) -> DataFrame:
    """Outputs that are spendable and their transaction's last."""
    last = ledger.txout.groupBy("tx_id").agg(F.max("vout").alias("last"))
    return ledger.txout.join(last, "tx_id").select(F.col("out_id").alias("key"), (is_spendable(F.col("output_type")) & (F.col("vout") == F.col("last"))).alias("flag"))


def locktime_change(ledger: Ledger) -> DataFrame:
    """Outputs that are spendable and spent, where both transactions have a locktime."""
    times = ledger.tx.select("tx_id", F.coalesce(F.col("locktime") > 0, F.lit(False)).alias("timed"))
    ends = ledger.txin.where("prev_out_id IS NOT NULL").select(F.col("prev_out_id").alias("out_id"), "in_id", "tx_id").join(times, "tx_id", "left")
    # of several inputs the last one counts; by two numbers, which are hashed where a row of two would be sorted
    late = ends.groupBy("out_id").agg(F.max("in_id").alias("last"), F.max(F.when(F.col("timed"), F.col("in_id"))).alias("late")).where("last = late")
    outs = ledger.txout.select("out_id", "tx_id", is_spendable(F.col("output_type")).alias("spendable")).join(times, "tx_id").select("out_id", (F.col("spendable") & F.col("timed")).alias("may"))
    return outs.join(late.select("out_id", F.lit(True).alias("hit")), "out_id", "left").select(F.col("out_id").alias("key"), (F.col("may") & F.coalesce("hit", F.lit(False))).alias("flag"))


def script_match_change(ledger: Ledger) -> DataFrame:
    """The one output whose type is that of all inputs, where each input is resolved and of one type."""
    ins = ledger.spent.groupBy("tx_id").agg(F.min("prev_type").alias("t"), F.max("prev_type").alias("u"), F.count_if(F.col("prev_type").isNull()).alias("unknown"))
    ins = ins.where("t = u AND unknown = 0").select("tx_id", "t")
    counts = ledger.txout.groupBy("tx_id", F.col("output_type").alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("tx_id", "t")
    one = ins.join(counts, ["tx_id", "t"])
    outs = ledger.txout.join(one.withColumn("hit", F.lit(True)), (ledger.txout["tx_id"] == one["tx_id"]) & (ledger.txout["output_type"] == one["t"]), "left")
    return outs.select(F.col("out_id").alias("key"), (F.coalesce("hit", F.lit(False)) & is_spendable(F.col("output_type"))).alias("flag"))


def inputs_by_tx(ledger: Ledger) -> DataFrame:
    """What fingerprints need of each transaction's inputs, in one aggregation; columns that are not asked for are pruned.

    n_in, unknown (unresolved inputs), rbf, relative, input_types, mixed, and of
    the order of inputs: differ, up, down (amounts), by_point (outpoints).
    """
    w = Window.partitionBy("tx_id").orderBy("vin")
    point = F.struct("prev_tx_id", "prev_vout")
    seen = ledger.spent.select(
        "tx_id", "sequence", "prev_out_id", "prev_value", "prev_type",
        (F.lag("prev_value").over(w) <= F.col("prev_value")).alias("up"),
        (F.lag("prev_value").over(w) >= F.col("prev_value")).alias("down"),
        (F.lag(point).over(w) <= point).alias("by_point"),
    )
    return seen.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(F.col("prev_value").isNull()).alias("unknown"),
        F.bool_or(signals_rbf(F.col("sequence"))).alias("rbf"),
        F.bool_or(relative_locktime(F.col("sequence"))).alias("relative"),
        F.array_sort(F.collect_set("prev_type")).alias("input_types"),
        (F.min("prev_type") < F.max("prev_type")).alias("mixed"),
        (F.min("prev_value") < F.max("prev_value")).alias("differ"),
        F.bool_and("up").alias("up"),
        F.bool_and("down").alias("down"),
        F.bool_and("by_point").alias("by_point"),
    )


def outputs_by_tx(ledger: Ledger) -> DataFrame:
    """The same of outputs: n_out, output_types, sorted (by value and script)."""
    w = Window.partitionBy("tx_id").orderBy("vout")
    pair = F.struct("value", "spk")
    seen = ledger.txout.select("tx_id", "output_type", (F.lag(pair).over(w) <= pair).alias("ok"))
    return seen.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_out"), F.array_sort(F.collect_set("output_type")).alias("output_types"), F.bool_and("ok").alias("sorted"))


def _no(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _locktime_columns() -> list[Column]:
    return [
        (F.col("locktime") != 0).alias("anti_fee_snipe"),
        ((F.col("locktime") == 0) & _no("rbf")).alias("optin_without_use"),
        ((F.col("locktime") > 0) & _no("relative")).alias("bip68_with_locktime"),
    ]


def _orders() -> Column:
    many = F.array_compact(F.array(F.when(_no(F.col("differ") & F.col("up")), 1), F.when(_no(F.col("differ") & F.col("down")), 2), F.when(_no("by_point"), 3)))
    n = F.coalesce("n_in", F.lit(0))
    return F.when(n == 0, F.array(F.lit(3))).when(F.col("unknown") > 0, F.lit(None)).when(n == 1, F.array(F.lit(0))).when(F.size(many) == 0, F.array(F.lit(5))).otherwise(many)


def locktime_flags(ledger: Ledger) -> DataFrame:
    """anti_fee_snipe, optin_without_use and bip68_with_locktime of each transaction."""
    return ledger.tx.select("tx_id", "locktime").join(inputs_by_tx(ledger).select("tx_id", "rbf", "relative"), "tx_id", "left").select("tx_id", *_locktime_columns())


def input_order(ledger: Ledger) -> DataFrame:
    """orders: sorted list of 0 single, 1 ascending, 2 descending, 3 by outpoint (what no input is too), 5 none of these.

    Ascending and descending are told only where the amounts differ; an input
    that is not resolved makes the list null.
    """
    by = inputs_by_tx(ledger).select("tx_id", "n_in", "unknown", "differ", "up", "down", "by_point")
    return ledger.tx.select("tx_id").join(by, "tx_id", "left").select("tx_id", _orders().alias("orders"))


def outputs_bip69(ledger: Ledger) -> DataFrame:
    """Whether each transaction's outputs are in the order of (value, script); none or one are."""
    return ledger.tx.select("tx_id").join(outputs_by_tx(ledger).select("tx_id", "sorted"), "tx_id", "left").select("tx_id", F.coalesce("sorted", F.lit(True)).alias("sorted"))


def type_sets(ledger: Ledger) -> DataFrame:
    """output_types and input_types of each transaction: sorted distinct numbers (at most seven)."""
    outs = ledger.txout.groupBy("tx_id").agg(F.array_sort(F.collect_set("output_type")).alias("output_types"))
    ins = ledger.spent.where("prev_type IS NOT NULL").groupBy("tx_id").agg(F.array_sort(F.collect_set("prev_type")).alias("input_types"))
    none = F.array().cast("array<int>")
    both = ledger.tx.select("tx_id").join(outs, "tx_id", "left").join(ins, "tx_id", "left")
    return both.select("tx_id", F.coalesce("output_types", none).alias("output_types"), F.coalesce("input_types", none).alias("input_types"))


def fingerprints(ledger: Ledger, **own: Callable[[Ledger], DataFrame]) -> DataFrame:
    """The wallet fingerprints that need no script bytes, a column each, and ``vector``: all of them as one list of numbers.

    One aggregation of inputs, one of outputs, and the semi-join of reuse.  A
    transaction with an unresolved input has a null vector.  own: further
    fingerprints by name, each a function from the ledger to a mask; they are
    columns, and stand behind the others in the vector.
    """
    none = F.array().cast("array<int>")
    reuse = address_reuse(ledger).select(F.col("key").alias("tx_id"), F.col("flag").alias("reuse"))
    both = ledger.tx.select("tx_id", "locktime").join(inputs_by_tx(ledger), "tx_id", "left").join(outputs_by_tx(ledger), "tx_id", "left").join(reuse, "tx_id")
    n = F.coalesce("n_out", F.lit(0))
    wide = both.select(
        "tx_id", _no("rbf").alias("rbf"), *_locktime_columns(), F.coalesce("output_types", none).alias("output_types"),
        F.when(n == 1, 0).when(n == 2, 1).otherwise(2).alias("structure"), F.coalesce("sorted", F.lit(True)).alias("sorted"),
        F.coalesce("input_types", none).alias("input_types"), _no("mixed").alias("mixed"), "reuse", _orders().alias("orders"), (F.coalesce("unknown", F.lit(0)) > 0).alias("open"),
    )
    one = lambda *names: F.array(*[F.col(n).cast("int") for n in names])
    vector = F.concat(one("rbf", "anti_fee_snipe", "optin_without_use", "bip68_with_locktime"), "output_types", one("structure", "sorted"), "input_types", one("mixed", "reuse"), "orders")
    for name, mask in own.items():
        wide = wide.join(mask(ledger).select(F.col("key").alias("tx_id"), F.col("flag").alias(name)), "tx_id", "left").withColumn(name, _no(name))
        vector = F.concat(vector, one(name))
    return wide.withColumn("vector", F.when(~F.col("open"), vector)).drop("open")


def script_fingerprints(ledger: Ledger) -> DataFrame:
    """low_r, uncompressed and taproot_sighash of each transaction: whether some input shows it.

    For ledgers whose inputs keep script_sig and witness and whose scripts are
    bytes.  An unresolved input leaves the two that need its script null.
    """
    columns = ["tx_id", "script_sig", "witness", "prev_spk"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[], [], []]
            for script, witness, spk in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                i = rawtx.TxIn(b"", 0, script or b"", 0, witness or [])
                found[0].append(rawtx.low_r(i))
                found[1].append(None if spk is None else rawtx.uncompressed_key(i, spk))
                found[2].append(None if spk is None else rawtx.taproot_sighash(i, spk))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.bool_()) for x in found)], ["tx_id", *SCRIPT_FINGERPRINTS])

    seen = mapped(ledger.spent.select(*columns), task, "tx_id long, " + ", ".join(f"{n} boolean" for n in SCRIPT_FINGERPRINTS))
    known = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.bool_or(c))
    by = seen.groupBy("tx_id").agg(*[known(n).alias(n) for n in SCRIPT_FINGERPRINTS])
    return ledger.tx.select("tx_id").join(by, "tx_id", "left").fillna(False, ["low_r"])
