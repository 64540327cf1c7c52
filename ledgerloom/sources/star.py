"""A deterministic ledger over the star schema: orders are transactions, their lines are outputs.

An output is spent by the next order with the same part, where the part number
is even and both are spendable; see ``LEDGER_SQL`` for the same in SQL.  Lines that its
order leaves tied are numbered as they stand in the file, in each run the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.checkpoints import stored
from ledgerloom.ledger import Ledger

BLOCK = 100  # transactions a block

LEDGER_SQL = f"""
outs AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS out_id, l_orderkey AS tx_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS vout,
    CAST(l_quantity AS BIGINT) * 100 AS value, l_suppkey AS spk, l_suppkey % 7 AS output_type, l_partkey AS part
  FROM lineitem
),
txout AS (SELECT out_id, tx_id, vout, value, spk, output_type FROM outs),
led AS (
  SELECT out_id, tx_id, lead(tx_id) OVER (PARTITION BY part ORDER BY out_id) AS spender
  FROM outs WHERE output_type NOT IN (5, 6) AND part % 2 = 0
),
txin AS (
  SELECT row_number() OVER (ORDER BY spender, out_id) - 1 AS in_id, spender AS tx_id,
    row_number() OVER (PARTITION BY spender ORDER BY out_id) - 1 AS vin, out_id AS prev_out_id,
    CASE out_id % 3 WHEN 0 THEN 4294967293 WHEN 1 THEN 4294967294 ELSE 1 END AS sequence
  FROM led WHERE spender IS NOT NULL AND spender <> tx_id
),
tx AS (
  SELECT o_orderkey AS tx_id,
    CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_orderkey + 1 ELSE 0 END AS locktime,
    o_orderkey // {BLOCK} AS block_height
  FROM orders
),
spent AS (
  SELECT i.*, o.value AS prev_value, o.spk AS prev_spk, o.output_type AS prev_type, o.tx_id AS prev_tx_id, o.vout AS prev_vout
  FROM txin i LEFT JOIN txout o ON i.prev_out_id = o.out_id
)"""


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def height(tx_id: Column) -> Column:
    """The block of a transaction."""
    return F.floor(tx_id / BLOCK).cast("long")


#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROWS = 33


def _numbered(rows: DataFrame, key: str, order: list[str], place: str, ordinal: str) -> DataFrame:
    """Rows with their place among those of the same key and among all, from 0, in the order of the key and of ``order``.

    One shuffle deals them into ranges of the key; a range's rows are numbered where they lie, kept as a
    table, and the sizes of the ranges before are added.
    """
    dealt = rows.repartitionByRange(key).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id())
    within = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    placed, _ = stored(dealt.withColumn(place, (within - 1).cast("long")).drop(*(c for c in order if c.startswith("l_"))))
    placed = placed.withColumn("range", F.shiftright("at", _ROWS))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each partition
    numbered = placed.join(F.broadcast(before), "range")
    return numbered.withColumn(ordinal, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROWS) - 1))).cast("long")).drop("range", "at", "before")


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey", "l_partkey", F.col("_metadata.row_index").alias("l_row"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    rows = lines.select(
        _long("l_orderkey").alias("tx_id"),
        "l_linenumber",
        "l_extendedprice",
        "l_row",
        (_long("l_quantity") * 100).alias("value"),
        _long("l_suppkey").alias("spk"),
        (_long("l_suppkey") % 7).cast("int").alias("output_type"),
        _long("l_partkey").alias("part"),
    )
    outs = _numbered(rows, "tx_id", ["l_linenumber", "l_extendedprice", "l_row"], "vout", "out_id")
    by_part = Window.partitionBy("part").orderBy("out_id")
    moves = (
        outs.where("output_type NOT IN (5, 6) AND part % 2 = 0")
        .select("out_id", "tx_id", F.lead("tx_id").over(by_part).alias("spender"))
        .where("spender IS NOT NULL AND spender <> tx_id")
    )
    ins = _numbered(moves.select(F.col("spender").alias("tx_id"), F.col("out_id").alias("prev_out_id")), "tx_id", ["prev_out_id"], "vin", "in_id")
    sequence = F.when(F.col("prev_out_id") % 3 == 0, F.lit(4294967293)).when(F.col("prev_out_id") % 3 == 1, F.lit(4294967294)).otherwise(F.lit(1))
    ins = ins.select("in_id", "tx_id", "vin", "prev_out_id", sequence.cast("long").alias("sequence"))
    tx = orders.select(
        _long("o_orderkey").alias("tx_id"),
        F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), _long("o_orderkey") + 1).otherwise(F.lit(0).cast("long")).alias("locktime"),
        height(_long("o_orderkey")).alias("block_height"),
    )
    return Ledger(tx, ins, outs.select("out_id", "tx_id", "vout", "value", "spk", "output_type"))


def loose_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id of each order: open orders ('P') are unconfirmed, their key is the order number plus 1."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return orders.select(F.when(F.col("o_orderstatus") == "P", -(_long("o_orderkey") + 1)).otherwise(_long("o_orderkey")).alias("tx_id"))
