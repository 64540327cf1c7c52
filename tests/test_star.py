"""The ledger view over the star schema: numbered by one shuffle of its lines, kept by blocks."""

from pyspark.sql import functions as F

from ledgerloom.ledger import Ledger
from ledgerloom.sources import star, store

SF = "/root/testdata/sf0.001"


def test_view_is_taken_in_without_joins(spark, tmp_path):
    """Numbers and blocks of outputs and inputs are looked up nowhere, so storing the view shuffles no rows again."""
    g = star.ledger(spark, SF)
    for df in (g.txin, g.txout):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(tx_id" not in plan
    placed = Ledger(g.tx, *(df.withColumn("block_height", star.height(F.col("tx_id"))) for df in (g.txin, g.txout)))
    store.save(placed, str(tmp_path))
    back = store.load(spark, str(tmp_path))
    for name in ("tx", "txin", "txout"):
        assert sorted(map(tuple, getattr(back, name).collect())) == sorted(map(tuple, getattr(g, name).collect()))


def test_numbers_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 900).alias("tx_id"), (F.col("id") * 31 % 5003).alias("prev_out_id"))
    got = star._numbered(rows.repartition(7), "tx_id", ["prev_out_id"], "vin", "in_id").orderBy("tx_id", "prev_out_id").collect()
    assert [r["in_id"] for r in got] == list(range(5000))
    seen = {}
    for r in got:
        assert r["vin"] == seen.get(r["tx_id"], 0)
        seen[r["tx_id"]] = r["vin"] + 1


def test_tied_lines_are_numbered_as_they_stand(spark, tmp_path, monkeypatch):
    """Lines of one number and price, which the order of the SQL leaves open, keep the order of the file, in whatever order tasks get them."""
    lines = [(i % 50, 1, 2000 - i, 1, 1.0, 5.0) for i in range(2000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "1") for k in range(50)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    real = star._numbered
    monkeypatch.setattr(star, "_numbered", lambda rows, *rest: real(rows.repartition(7).localCheckpoint(), *rest))
    outs = star.ledger(spark, str(tmp_path)).txout.orderBy("out_id").collect()
    assert [r["spk"] for r in outs] == [2000 - i for k in range(50) for i in range(k, 2000, 50)]
