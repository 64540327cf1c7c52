"""What a query moves and holds as its tables grow, told from its plan or from what its steps are given."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.checkpoints import folder
from ledgerloom.functions import encode, scripts
from ledgerloom.ledger import Ledger
from ledgerloom.operators import balances, heuristics, metrics, subsets
from ledgerloom.sources import blocks
from test_subsets import ambiguous_subsets, spending

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark, make):
    """make's plan where no table is small enough to be broadcast of itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return plan(make())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_reads_its_book_once_and_shuffles_it_no_more(spark):
    outs = spark.createDataFrame([(0, 0, 0, 500), (1, 1, 0, 900), (2, 2, 0, 1200), (3, 3, 0, 500)], "out_id long, tx_id long, vout long, value long")
    confirmed, spending = spark.createDataFrame([(0,), (1,), (2,)], "tx_id long"), spark.createDataFrame([(1,)], "out_id long")
    ranked = lambda: metrics.cospend_ranking(metrics.order_book(outs, confirmed, spending), outs.where("out_id = 1"))
    assert "SortMergeJoin" not in shuffled(spark, ranked)
    assert sorted((r["out_id"], r["distance"]) for r in ranked().collect()) == [(0, 400), (2, 300)]


def test_each_script_is_hashed_once(spark, monkeypatch):
    given, real = [], scripts.spk_hash

    def seen(df, spk="spk"):
        given.append(df.count())
        return real(df, spk)

    monkeypatch.setattr(scripts, "spk_hash", seen)
    outs = queries.ledger(spark, SF).txout
    found = queries.QUERIES["script_hashes"](spark, SF)
    assert given == [outs.select("spk", "output_type").distinct().count()] and given[0] < outs.count()
    monkeypatch.setattr(queries, "_FEW_SCRIPTS", 1)
    assert sorted(queries.QUERIES["script_hashes"](spark, SF).collect()) == sorted(found.collect())


def test_locktime_change_sorts_no_aggregate(spark):
    g = queries.ledger(spark, SF)
    assert "SortAggregate" not in shuffled(spark, lambda: heuristics.locktime_change(g))


def test_locktime_change_of_outputs_spent_twice(spark):
    """The last input counts, of transactions that are not there too."""
    tx = spark.createDataFrame([(1, 5), (2, 7), (3, 0)], "tx_id long, locktime long")
    ins = spark.createDataFrame([(0, 2, 0), (1, 3, 0), (2, 3, 1), (3, 2, 1), (4, 2, 2), (5, 9, 2), (6, 2, 4)], "in_id long, tx_id long, prev_out_id long")
    outs = spark.createDataFrame([(0, 1, 0), (1, 1, 2), (2, 1, 4), (3, 1, 0), (4, 1, 5), (5, 8, 0)], "out_id long, tx_id long, output_type int")
    got = {r["key"]: r["flag"] for r in heuristics.locktime_change(Ledger(tx, ins, outs)).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False}


def uneven(spark, coins):
    """How many of the transactions of coins (tx_id, side, v) have sides of different totals."""
    return coins.groupBy("tx_id").agg(F.sum(F.when(F.col("side") == 0, F.col("v")).otherwise(-F.col("v"))).alias("d")).where("d <> 0").count()


def test_mapping_blocks_searches_balanced_transactions_alone(spark, monkeypatch):
    given, real = [], subsets.mapping_blocks
    monkeypatch.setattr(subsets, "mapping_blocks", lambda coins: (given.append(coins), real(coins))[1])
    assert queries.QUERIES["mapping_blocks"](spark, SF).count() > 0
    assert given[0].count() > 0 and uneven(spark, given[0]) == 0


def test_mapping_rows_number_coins_of_balanced_transactions_alone(spark, monkeypatch):
    given, real = [], balances._pairs
    monkeypatch.setattr(balances, "_pairs", lambda ins, outs, derived: (given.append(ins.select("tx_id", F.lit(0).alias("side"), "v").union(outs.select("tx_id", F.lit(1), "v"))), real(ins, outs, derived))[1])
    assert queries.QUERIES["mapping_rows"](spark, SF).count() > 0
    assert given[0].count() > 0 and uneven(spark, given[0]) == 0


def test_small_block_files_share_a_task(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("height"), F.expr("cast(repeat(char(65 + id), 100) as binary)").alias("block"))
    blocks.write(rows, str(tmp_path), size=300, parts=3)
    assert len(list(tmp_path.glob("blk*.dat"))) >= 15
    read = spark.read.format("blockfiles").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 1
    assert sorted(bytes(r["block"]) for r in read.collect()) == sorted(bytes(r["block"]) for r in rows.collect())


def test_numbers_of_transactions_behind_headers(spark):
    head = bytes(range(80))
    sizes = {b"\x01": 1, b"\xfc": 252, b"\xfd\x34\x12": 0x1234, b"\xfe\x78\x56\x34\x12": 0x12345678, b"\xff" + (5 << 32).to_bytes(8, "little"): 5 << 32}
    some = spark.createDataFrame([(k, 8, head + code + b"\x07" * 20) for k, code in enumerate(sizes)], "file_no int, offset long, block binary")
    got = blocks.summaries(some).orderBy("file_no").collect()
    assert [r["n_tx"] for r in got] == list(sizes.values())
    assert all(bytes(r["header"]) == head and r["size"] == 100 + len(code) for r, code in zip(got, sizes, strict=True))


def test_index_is_made_without_parsing_blocks(spark, tmp_path, monkeypatch):
    g = queries.ledger(spark, SF)
    queries._block_folder(g, f"{tmp_path}/blk")
    monkeypatch.setattr(blocks, "parsed", None)
    index = queries._index(spark, f"{tmp_path}/blk", f"{tmp_path}/index")
    assert index.blocks.agg(F.sum("n_tx")).first()[0] == g.tx.count()


def test_small_transactions_are_counted_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(balances, "_partitions_joined", None)  # nothing is left for joins
    g, txs = spending(spark, [([1, 3, 18], [3, 4, 19]), ([0, 5, 5], [5, 5, 0]), ([0, 0], [0]), ([2] * 8, [2] * 8), ([7], [3])])
    want = {k: sum(1 for _ in subsets.partitions(i, subsets.subset_sums(o))) for k, (i, o) in txs.items()}
    assert {r[0]: r[1] for r in balances.partition_counts(g).collect()} == want


def test_partitions_in_rows_as_by_joins(spark, monkeypatch):
    rng = random.Random(7)
    g, _ = spending(spark, [tuple([rng.choice([0, 1, 2, 3, 5, 7]) for _ in range(rng.randint(1, 6))] for _ in range(2)) for _ in range(40)])
    in_rows = sorted(balances.partition_counts(g).collect())
    monkeypatch.setattr(balances, "SMALL", 2)
    assert sorted(balances.partition_counts(g).collect()) == in_rows


def test_sums_are_made_in_rows(spark, monkeypatch):
    g, txs = spending(spark, [([1, 3, 18], [3, 4, 19]), ([0, 5, 5], [5, 5, 0]), ([0, 0], [0]), ([2] * 8, [2] * 16), ([7], [1, 2, 4, 8, 16]), ([5], [1 << 40] * 3)])
    want = {k: len(subsets.subset_sums(o)) for k, (_, o) in txs.items()}
    with monkeypatch.context() as m:
        m.setattr(balances, "_sums", None)  # nothing is left for joins
        assert {r[0]: r[1] for r in balances.sum_counts(g).collect()} == want
    monkeypatch.setattr(balances, "SUMMED", 2)
    assert {r[0]: r[1] for r in balances.sum_counts(g).collect()} == want


def test_ambiguous_subsets_are_counted_in_rows(spark, monkeypatch):
    rng = random.Random(3)
    some = [([2] * 12, [2] * 16), ([0, 5, 5], [5, 5, 0]), ([7], [7]), ([1, 1], [0])]
    some += [tuple([rng.choice([0, 1, 2, 3, 5, 7]) for _ in range(rng.randint(1, 6))] for _ in range(2)) for _ in range(30)]
    g, txs = spending(spark, some)
    for depth in (1, 8):
        want = {k: ambiguous_subsets(i, o, depth) for k, (i, o) in txs.items()}
        with monkeypatch.context() as m:
            m.setattr(balances, "_sums", None)  # nothing is left for joins
            assert {r[0]: r[1] for r in balances.ambiguous(g, depth).collect()} == want
        with monkeypatch.context() as m:
            m.setattr(balances, "TAKEN", 3)
            assert {r[0]: r[1] for r in balances.ambiguous(g, depth).collect()} == want


def test_privacy_of_small_transactions_needs_no_joins_of_sums(spark, monkeypatch):
    monkeypatch.setattr(balances, "_balanced", None)
    g, txs = spending(spark, [([1, 3, 18], [3, 4, 19]), ([2] * 8, [2] * 8), ([7], [3])])
    want = {k: 1 / (1 + ambiguous_subsets(i, o)) for k, (i, o) in txs.items()}
    assert {r[0]: r[1] for r in balances.privacy(g).collect()} == want


def test_blocks_are_made_without_checkpoints_of_rows(spark):
    """Steps are kept as tables, and only the transactions' and the blocks' are left."""
    place = Path(folder(spark.sparkContext).removeprefix("file:"))
    g = queries._generations(queries.ledger(spark, SF))
    rows, tables = set(place.glob("rdd-*")), set(place.glob("stored-*"))
    made = encode.blocks(encode.transactions(g))
    assert made.agg(F.sum("n_tx")).first()[0] == g.tx.count()
    assert set(place.glob("rdd-*")) <= rows and len(set(place.glob("stored-*")) - tables) == 1


def test_stored_parents_are_looked_up_without_a_shuffle_of_them(spark, monkeypatch):
    given, real = [], queries.linking.link

    def seen(inputs, outputs, *rest, stored):
        given.append((stored.schema["txid"].dataType.typeName(), "Exchange hashpartitioning" in plan(stored.groupBy("txid", "vout").count())))
        return real(inputs, outputs, *rest, stored=stored)

    monkeypatch.setattr(queries.linking, "link", seen)
    assert queries.QUERIES["stream_late_parents"](spark, SF).count() > 0
    assert given == [("binary", False)] * 5
