import pytest
from ledgers import BASE, clusters, flags, ledger

from ledgerloom.functions.scripts import OP_RETURN
from ledgerloom.operators import clustering, heuristics, masks, navigation


def test_base(spark):
    g, ids = ledger(spark, BASE)
    assert clusters(clustering.cluster(clustering.multi_input_edges(g))) == [[ids[1, 0], ids[2, 0]]]
    change = heuristics.naive_change(g)
    assert flags(change)[ids[3, 1]] and not flags(change)[ids[3, 0]]
    assert not any(flags(heuristics.locktime_change(g)).values())
    joined = clustering.join(clustering.cluster(clustering.multi_input_edges(g)), clustering.cluster(clustering.change_edges(g, change)))
    assert clusters(joined) == [sorted([ids[1, 0], ids[2, 0], ids[3, 1]])]
    assert flags(clustering.is_unilateral(g, joined)) == {1: False, 2: False, 3: True}


def test_coinjoin(spark):
    g, _ = ledger(spark, [([100, 200], []), ([100, 100, 100], [])])
    assert flags(heuristics.is_coinjoin(g)) == {1: False, 2: True}


def test_change_chain(spark):
    g, ids = ledger(spark, [([1000], []), ([700, 300], [(1, 0)]), ([500], []), ([400, 100], [(2, 1), (3, 0)])])
    found = clusters(clustering.cluster(clustering.change_edges(g, heuristics.naive_change(g))))
    assert [ids[1, 0], ids[2, 1], ids[4, 1]] in found


def test_no_merge(spark):
    g, ids = ledger(spark, [([1000], []), ([700, 300], [(1, 0)]), ([300], [(2, 1)]), ([700], [(2, 0)])])
    for c in clusters(clustering.cluster(clustering.change_edges(g, heuristics.naive_change(g)))):
        assert not {ids[2, 0], ids[2, 1]} <= set(c)


@pytest.mark.parametrize(("ins", "outs", "hits"), [([100, 200], [50, 250], [0]), ([50, 100], [80, 70], []), ([100, 200], [50, 50], [0, 1])])
def test_uih1(spark, ins, outs, hits):
    g, ids = ledger(spark, [([v], []) for v in ins] + [(outs, [(1, 0), (2, 0)])])
    found = flags(heuristics.uih1(g))
    assert [v for v in range(len(outs)) if found[ids[3, v]]] == hits
    assert not found[ids[1, 0]]


@pytest.mark.parametrize(("ins", "outs", "flag"), [([100, 150], [100, 150], True), ([100, 200], [250, 40], False), ([100, 200], [200, 0], True), ([500], [200, 300], False)])
def test_uih2(spark, ins, outs, flag):
    g, _ = ledger(spark, [([v], []) for v in ins] + [(outs, [(k + 1, 0) for k in range(len(ins))])])
    assert flags(heuristics.uih2(g))[len(ins) + 1] is flag


def test_unspendable(spark):
    g, ids = ledger(spark, [([100], []), ([10, 20], [(1, 0)])], types={(2, 1): OP_RETURN})
    assert not flags(heuristics.naive_change(g))[ids[2, 1]]
    assert flags(heuristics.uih1(g))[ids[2, 0]] and not flags(heuristics.uih1(g))[ids[2, 1]]


@pytest.mark.parametrize(("times", "flag"), [({1: 0, 2: 0}, False), ({1: 1, 2: 1}, True), ({1: 1, 2: 0}, False)])
def test_locktime_change(spark, times, flag):
    g, ids = ledger(spark, [([100], []), ([90], [(1, 0)])], locktimes=times)
    found = flags(heuristics.locktime_change(g))
    assert found[ids[1, 0]] is flag and not found[ids[2, 0]]


@pytest.mark.parametrize(("ins", "outs", "hit"), [([0, 0], [4, 0], 1), ([0, 4], [4, 0], None), ([0, 0], [0, 0], None)])
def test_script_match(spark, ins, outs, hit):
    types = {(1, 0): ins[0], (2, 0): ins[1], (3, 0): outs[0], (3, 1): outs[1]}
    g, ids = ledger(spark, [([100], []), ([100], []), ([50, 60], [(1, 0), (2, 0)])], types=types)
    found = flags(heuristics.script_match_change(g))
    assert [v for v in (0, 1) if found[ids[3, v]]] == ([] if hit is None else [hit])


def test_same_script(spark):
    spks = {(1, 0): 1, (2, 0): 2, (3, 0): 1, (3, 1): 9, (4, 0): 2, (4, 1): 9}
    g, ids = ledger(spark, [([100], []), ([100], []), ([50, 40], [(1, 0)]), ([50, 40], [(2, 0)])], spks=spks)
    found = clusters(clustering.same_script(g))
    assert [ids[3, 1], ids[4, 1]] in found and [ids[1, 0], ids[3, 0]] in found
    some = clustering.same_script(g, g.txout.where("tx_id = 4"))
    assert [ids[3, 1], ids[4, 1]] in clusters(some)


def test_unresolved_inputs(spark):
    g, _ = ledger(spark, BASE)
    late = g.above(3)
    assert late.spent.where("prev_value IS NOT NULL").count() == 0
    assert flags(heuristics.uih2(late)) == {3: False}
    assert [r["orders"] for r in heuristics.input_order(late).collect()] == [None]
    assert [r["vector"] for r in heuristics.fingerprints(late).collect()] == [None]
    assert clusters(clustering.cluster(clustering.multi_input_edges(late))) == []


@pytest.mark.parametrize(("ins", "orders"), [([5], [0]), ([1, 2], [1, 3]), ([2, 1], [2, 3]), ([3, 3], [3]), ([], [3])])
def test_input_order(spark, ins, orders):
    g, _ = ledger(spark, [([v], []) for v in ins] + [([1], [(k + 1, 0) for k in range(len(ins))])])
    found = {r["tx_id"]: r["orders"] for r in heuristics.input_order(g).collect()}
    assert found[len(ins) + 1] == orders


def test_input_order_unknown(spark):
    g, _ = ledger(spark, [([1], []), ([3], []), ([2], []), ([1], [(2, 0), (1, 0), (3, 0)])])
    assert {r["tx_id"]: r["orders"] for r in heuristics.input_order(g).collect()}[4] == [5]


def test_masks(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "key long, flag boolean")
    a, b = {1: True, 2: False, 3: True}, {2: True, 3: True, 4: True}
    assert flags(masks.both(make(a), make(b))) == {1: False, 2: False, 3: True, 4: False}
    assert flags(masks.either(make(a), make(b))) == {1: True, 2: True, 3: True, 4: True}
    assert flags(masks.negate(make(a))) == {1: False, 2: True, 3: False}
    # De Morgan, on equal keys
    c = {1: False, 2: True, 3: True}
    left = masks.negate(masks.both(make(a), make(c)))
    assert flags(left) == flags(masks.either(masks.negate(make(a)), masks.negate(make(c))))
    items = spark.createDataFrame([(k,) for k in (1, 1, 2, 9)], "tx_id long")
    assert sorted(r[0] for r in masks.keep(items, make(a), "tx_id").collect()) == [1, 1]
    assert sorted(r[0] for r in masks.exclude(items, make(a), "tx_id").collect()) == [2, 9]


def test_navigation_keeps_repeats(spark):
    g, _ = ledger(spark, BASE)
    outs = navigation.outputs_of(spark.createDataFrame([(1,), (1,)], "tx_id long"), g)
    assert outs.count() == 4
    assert sorted(r[0] for r in navigation.txs_of(outs.select("out_id"), g).collect()) == [1, 1, 1, 1]


def test_empty(spark):
    g, _ = ledger(spark, [])
    for f in (heuristics.is_coinjoin, heuristics.uih1, heuristics.uih2, heuristics.naive_change, heuristics.fingerprints, navigation.value_sums, navigation.spending):
        assert f(g).count() == 0
    assert heuristics.rbf_share(g).first()["percent"] == 0.0
