import json
import subprocess
import sys

from ledgers import BASE, flags, ledger

from ledgerloom.operators import heuristics, navigation
from ledgerloom.sources import store


def test_save_and_load(spark, tmp_path):
    g, _ = ledger(spark, BASE)
    tall = type(g)(g.tx.selectExpr("tx_id", "locktime", "tx_id * 1000 AS block_height"), g.txin, g.txout)
    store.save(tall, str(tmp_path / "l"))
    back = store.load(spark, str(tmp_path / "l"))
    assert flags(heuristics.uih2(back)) == flags(heuristics.uih2(g))
    late = store.load(spark, str(tmp_path / "l"), low=2000)
    assert sorted(r[0] for r in late.tx.select("tx_id").collect()) == [2, 3]
    assert [r["n_resolved"] for r in navigation.value_sums(late).where("tx_id = 3").collect()] == [1]
    assert store.load(spark, str(tmp_path / "l"), high=1500).tx.count() == 1


def test_append_get_and_put(spark, tmp_path):
    g, _ = ledger(spark, BASE)
    folder, tall = str(tmp_path / "l"), type(g)(g.tx.selectExpr("tx_id", "locktime", "tx_id * 1000 AS block_height"), g.txin, g.txout)
    store.save(store.part(tall, tall.tx.where("tx_id < 3")), folder)
    store.append(store.part(tall, tall.tx.where("tx_id = 3")), folder)
    back = store.load(spark, folder)
    assert back.tx.count() == 3 and back.txout.count() == g.txout.count()
    ids = spark.createDataFrame([(1,), (3,), (77,)], "tx_id long")
    assert sorted(r["tx_id"] for r in store.get(spark, folder, "tx", ids).collect()) == [1, 3]
    rows = spark.createDataFrame([(3, 9, 3000, 3), (4, 8, 3500, 3)], "tx_id long, locktime long, block_height long, bucket long")
    store.put(rows, folder, "tx")
    assert {r["tx_id"]: r["locktime"] for r in store.load(spark, folder).tx.collect()} == {1: 0, 2: 0, 3: 9, 4: 8}


def test_sinks(spark):
    """A sink of one's own sees every table, and the blocks at the end."""
    seen = {}

    class Counts(store.Sink):
        def on_transactions(self, tx):
            seen["tx"] = tx.count()

        def on_outputs(self, txout):
            seen["values"] = sorted(r["value"] for r in txout.collect())

        def on_blocks_end(self, heights):
            seen["blocks"] = [r[0] for r in heights.collect()]

    g, _ = ledger(spark, BASE)
    store.feed(g, Counts(), store.Sink())
    assert seen == {"tx": 3, "values": [100, 100, 150, 150, 150], "blocks": [0]}


def test_assembled(spark):
    g, ids = ledger(spark, BASE)
    got = {r["tx_id"]: r for r in navigation.assembled(spark.createDataFrame([(1,), (3,), (3,)], "tx_id long"), g).collect()}
    assert [o["value"] for o in got[1]["outputs"]] == [100, 150] and got[1]["inputs"] == []
    assert [(i["prev_out_id"], i["prev_value"]) for i in got[3]["inputs"]] == [(ids[1, 0], 100), (ids[2, 0], 150)] and len(got) == 2


def test_spk_hash(spark):
    from ledgerloom.functions.scripts import spk_hash

    df = spark.createDataFrame([(b"",), (None,)], "spk binary")
    got = [r[0] if r[0] is None else bytes(r[0]).hex() for r in df.select(spk_hash(df)).collect()]
    assert got == ["b472a266d0bd89c13706a4132ccfb16f7c3b9fcb", None]


def test_conflicts(spark):
    from ledgerloom.operators import metrics

    pending = spark.createDataFrame([(-1, 5), (-2, 6), (-3, 6), (-4, 7), (-5, None), (-6, None)], "tx_id long, prev_out_id long")
    confirmed = spark.createDataFrame([(1, 5)], "tx_id long, prev_out_id long")
    assert sorted(r[0] for r in metrics.conflicts(pending, confirmed).collect()) == [-3, -2, -1]


def test_own_fingerprints(spark):
    g, _ = ledger(spark, BASE)
    got = heuristics.fingerprints(g, big=lambda g: g.tx.selectExpr("tx_id AS key", "tx_id > 2 AS flag"))
    assert {r["tx_id"]: (r["big"], r["vector"][-1]) for r in got.collect()} == {1: (False, 0), 2: (False, 0), 3: (True, 1)}


def test_builder(spark):
    b = store.Builder()
    first = b.add([100, 200], [(2, 0)])  # spends a later one
    b.add([300])
    b.add([5], [(first, 1), (99, 0)])
    g = b.ledger(spark)
    assert sorted(r[0] for r in navigation.loose_txs(g.tx).collect()) == [-3, -2, -1]
    got = {(r["tx_id"], r["vin"]): r["prev_value"] for r in g.spent.collect()}
    assert got == {(-1, 0): 300, (-3, 0): 200, (-3, 1): None}
    dense, _ = ledger(spark, BASE)
    dense = type(dense)(dense.tx, dense.txin, dense.txout.withColumn("spk", dense.txout["spk"].cast("string").cast("binary")))
    both = store.together(dense, g)
    assert both.tx.count() == 6 and navigation.dense_txs(both.tx).count() == 3
    assert sum(flags(heuristics.rbf_mask(both)).values()) == 3


def test_script_fingerprints(spark):
    from test_raw import P2PKH, P2TR, der

    key = b"\x04" + bytes(64)
    tx = spark.createDataFrame([(1,), (2,), (3,), (4,)], "tx_id long")
    outs = spark.createDataFrame([(10, 0, P2PKH), (11, 0, P2TR), (12, 0, P2PKH)], "out_id long, value long, spk binary").selectExpr("out_id", "9L AS tx_id", "0L AS vout", "value", "spk", "0 AS output_type")
    ins = spark.createDataFrame(
        [(1, 1, 0, 10, bytes([65]) + key, []), (2, 2, 0, 11, b"", [bytes(65)]), (3, 2, 1, 12, b"", [der(b"\x11" * 32)]), (4, 3, 0, None, b"", [der(b"\x00" + b"\x91" * 32)])],
        "in_id long, tx_id long, vin long, prev_out_id long, script_sig binary, witness array<binary>",
    ).selectExpr("*", "0L AS sequence")
    from ledgerloom.ledger import Ledger

    got = {r["tx_id"]: (r["low_r"], r["uncompressed"], r["taproot_sighash"]) for r in heuristics.script_fingerprints(Ledger(tx, ins, outs)).collect()}
    assert got == {1: (False, True, False), 2: (True, False, True), 3: (False, None, None), 4: (False, None, None)}


def test_simulator_command(tmp_path):
    from test_simulator import HEAD, TYPE

    (tmp_path / "c.toml").write_text(HEAD.format(seed=1, steps=12, n=4) + TYPE.format(name="w", count=3, strategy="UnilateralSpender", script="p2wpkh", privacy=0, weight=1))
    subprocess.run([sys.executable, "-m", "ledgerloom.simulator", str(tmp_path / "c.toml"), str(tmp_path / "out")], check=True)
    assert json.loads((tmp_path / "out/results.json").read_text())["total_payment_obligations"] == 4
