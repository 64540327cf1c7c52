import pytest
from ledgers import BASE, clusters, flags, ledger
from pyspark.sql import functions as F

from ledgerloom.operators import clustering, heuristics
from ledgerloom.plans import facts
from ledgerloom.plans.dag import Clustering, Context, Engine, Expr, Mask, NoFacts, Placeholder, TxSet
from ledgerloom.sources import store
from ledgerloom.streaming import incremental


def test_expressions(spark):
    g, ids = ledger(spark, BASE)
    c = Context()
    txs = c.all_txs()
    engine = Engine(g)
    assert sorted(r[0] for r in engine.eval(txs.filter(F.col("tx_id") > 1).outputs().txs()).collect()) == [2, 3, 3]
    change = txs.outputs().mask(heuristics.naive_change)
    assert flags(engine.eval(change & change)) == flags(engine.eval(change))  # the same one twice
    assert flags(engine.eval(change | change.negate())) == dict.fromkeys(range(5), True)
    assert clusters(engine.eval(txs.multi_input().join(change.change_clusters()))) == [sorted([ids[1, 0], ids[2, 0], ids[3, 1]])]
    assert len(c) == len(c.names()) and txs.node.id in c


def test_user_operation(spark):
    g, _ = ledger(spark, BASE)
    c = Context()
    own = c.all_txs().apply(TxSet, "even", lambda g, x: x.where("tx_id % 2 = 0"))
    assert [r[0] for r in Engine(g).eval(own).collect()] == [2]


def test_placeholder(spark):
    c = Context()
    p = Placeholder(c, Mask)
    with pytest.raises(TypeError):
        p.unify(c.all_txs())
    p.unify(p.expr.negate())
    with pytest.raises(ValueError, match="already"):
        p.unify(p.expr)
    g, _ = ledger(spark, [])
    assert Engine(g).eval(p.expr).count() == 0
    assert Engine(g).eval(Placeholder(c, Clustering).expr).count() == 0  # never unified: the default


CHAIN = [([1000], []), ([700, 300], [(1, 0)]), ([500], []), ([400, 100], [(2, 1), (3, 0)]), ([60, 40], [(4, 1)])]


def test_cycle(spark):
    """Clusters gated by what they themselves make unilateral; equal to the operator's loop."""
    g, _ = ledger(spark, CHAIN)
    c = Context()
    txs = c.all_txs()
    p = Placeholder(c, Clustering)
    gate = txs.unilateral(p.expr).on_outputs()
    change = txs.outputs().mask(heuristics.naive_change) & gate
    p.unify(txs.multi_input().join(change.change_clusters()))
    engine = Engine(g)
    got = clusters(engine.eval(p.expr))
    assert engine.rounds > 1
    none = spark.createDataFrame([], "key long, flag boolean")
    assert got == clusters(clustering.unilateral_fixpoint(g, heuristics.naive_change(g), none))


def test_cycle_makes_fixed_nodes_once(spark):
    g, _ = ledger(spark, CHAIN)
    c, calls = Context(), []
    fixed = c.all_txs().apply(TxSet, "counted", lambda g, x: calls.append(1) or x)
    p = Placeholder(c, Clustering)
    p.unify(fixed.multi_input().join(p.expr))
    engine = Engine(g)
    assert clusters(engine.eval(p.expr)) == clusters(engine.eval(fixed.multi_input()))
    assert len(calls) == 2  # once in each evaluation


def test_fixpoint_bounds(spark):
    g, _ = ledger(spark, [*CHAIN, ([10, 10, 10], [(5, 0), (5, 1)])])
    change, mixes = heuristics.naive_change(g), heuristics.is_coinjoin(g)
    got = clustering.unilateral_fixpoint(g, change, mixes)
    all_ = clustering.cluster(clustering.multi_input_edges(g).union(clustering.change_edges(g, change)))
    upper = clusters(all_)
    for group in clusters(got):
        assert any(set(group) <= set(u) for u in upper)


def test_set_operations(spark):
    g, _ = ledger(spark, BASE)
    c, engine = Context(), Engine(g)
    txs, some = c.all_txs(), c.all_txs().filter(F.col("tx_id") > 1)
    of = lambda e: sorted(r[0] for r in engine.eval(e).collect())
    assert of(txs.union(some)) == [1, 2, 2, 3, 3] and of(txs.intersect(some)) == [2, 3] and of(txs.subtract(some)) == [1]


def test_growing_ledger(spark):
    """Each expression sees what came since it was last asked; its facts add up to the evaluation of all."""
    g, _ = ledger(spark, CHAIN)
    first = store.part(g, g.tx.where("tx_id <= 3"))
    first = type(g)(first.tx, first.txin, g.txout.where("tx_id <= 3"))
    c, engine = Context(), Engine(first)
    txs = c.all_txs()
    clusters_, mask = txs.multi_input(), txs.mask(heuristics.rbf_mask)
    with pytest.raises(NoFacts):
        engine.get(txs)
    assert engine.get_or_default(txs).count() == 0
    assert sorted(r[0] for r in engine.advance(txs).collect()) == [1, 2, 3]
    assert clusters(engine.value(clusters_)) == []
    assert engine.advance(txs) is None
    engine.extend(g)
    assert sorted(r[0] for r in engine.advance(txs).collect()) == [4, 5]
    assert [f.count() for f in engine.evaluated_facts(txs)] == [3, 2] and engine.get(txs).count() == 5
    assert clusters(engine.value(clusters_)) == clusters(Engine(g).eval(clusters_))
    assert flags(engine.value(mask)) == flags(Engine(g).eval(mask))  # asked for the first time: all at once
    engine.set_base(txs, spark.createDataFrame([(99,)], "tx_id long"))
    assert engine.get(txs).count() == 6 and engine.take_base(txs).count() == 1 and engine.get(txs).count() == 5


def test_a_mask_looks_at_new_transactions_alone(spark):
    g, _ = ledger(spark, CHAIN)
    seen = []

    def own(some):
        seen.append((sorted(r[0] for r in some.tx.select("tx_id").collect()), some.txin.count(), some.spent.where("prev_value IS NULL AND prev_out_id IS NOT NULL").count()))
        return heuristics.uih2(some)

    for whole in (None, True):
        seen.clear()
        engine, txs = Engine(store.part(g, g.tx.where("tx_id <= 2"))), Context().all_txs()
        mask = txs.mask(own, whole=whole)
        engine.advance(mask)
        engine.extend(g)
        engine.advance(mask)
        assert flags(engine.value(mask)) == flags(heuristics.uih2(g))
        ids = sorted(r[0] for r in g.tx.select("tx_id").collect())
        assert [s[0] for s in seen][:2] == [[1, 2], ids if whole else [k for k in ids if k > 2]] and all(s[2] == 0 for s in seen)


def test_own_kind(spark):
    """A value type of one's own: a schema, and how its facts are put together."""

    class Total(Expr):
        SCHEMA = "n long"
        combine = staticmethod(lambda found: facts.combine_sets(found).agg(F.sum("n").alias("n")))

    g, _ = ledger(spark, CHAIN)
    c, engine = Context(), Engine(store.part(g, g.tx.where("tx_id <= 2")))
    total = c.all_txs().apply(Total, "count", lambda g, x: x.agg(F.count(F.lit(1)).alias("n")))
    assert engine.get_or_default(total).count() == 0
    assert engine.value(total).first()["n"] == 2
    engine.extend(g)
    assert engine.value(total).first()["n"] == 5


def test_fixpoint_against_brute_force(spark):
    """Random ledgers, with the loop over sets."""
    import random

    rng = random.Random(6)
    for _ in range(2):
        txs, free = [], []
        for t in range(1, 40):
            spends = [free.pop(rng.randrange(len(free))) for _ in range(min(len(free), rng.randrange(4)))]
            values = [rng.choice([10, 20, 30]) for _ in range(rng.randrange(1, 5))]
            txs.append((values, spends))
            free += [(t, v) for v in range(len(values))]
        g, ids = ledger(spark, txs)
        mixes = {t for t, (values, _) in enumerate(txs, 1) if max(map(values.count, values)) >= 3}
        links = [(ids[s[0]], ids[x]) for t, (_, s) in enumerate(txs, 1) if s and t not in mixes for x in s]
        while True:
            label = {i: i for i in ids.values()}
            for a, b in links * len(links):
                label[a] = label[b] = min(label[a], label[b])
            more = [(ids[t, len(v) - 1], ids[s[0]]) for t, (v, s) in enumerate(txs, 1) if s and len({label[ids[x]] for x in s}) == 1]
            if set(more) <= set(links):
                break
            links = list(dict.fromkeys(links + more))
        want = {}
        for i, x in label.items():
            want.setdefault(x, set()).add(i)
        got = clusters(clustering.unilateral_fixpoint(g, heuristics.naive_change(g), heuristics.is_coinjoin(g)))
        assert [x for x in got if len(x) > 1] == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_equal_clusterings(spark):
    made = lambda *edges: clustering.cluster(spark.createDataFrame(edges, "a long, b long"))
    assert clustering.equal(made((1, 2), (2, 3)), made((3, 1), (2, 1)))
    assert not clustering.equal(made((1, 2), (2, 3)), made((1, 2), (3, 3)))
    got = clustering.differences(made((1, 2)), made((1, 2), (4, 5))).collect()
    assert sorted(map(tuple, got)) == [(4, None, 4), (5, None, 4)]
    grown = clustering.grown(made((1, 2), (7, 8)), spark.createDataFrame([(8, 2), (9, 9), (10, 1), (2, 2)], "a long, b long"))
    assert clusters(grown) == [[1, 2, 7, 8, 10], [9]]


def test_clustering_as_state(spark, tmp_path):
    """A batch's edges join the clusters of the state before; a batch that runs again begins from the same state."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    step = lambda df: df.select("a", "b")
    for k, edges in enumerate([[(1, 2), (5, 6)], [(2, 3), (9, 9)], [(6, 3)]]):
        spark.createDataFrame(edges, "a long, b long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("a long, b long").parquet(source)
        incremental.maintain_clustering(stream, step, target, str(tmp_path / "check")).awaitTermination()
        assert incremental._states(spark, target)[-1][0] == k
    assert clusters(incremental.clustering_state(spark, target)) == [[1, 2, 3, 5, 6], [9]]


def test_state_writes_changed_labels_only(spark, tmp_path):
    source, target = tmp_path / "edges", str(tmp_path / "states")
    source.mkdir()
    schema = "a long, b long"
    batches = [[(10, 11), (20, 21), (30, 31)], [(31, 32)], [(11, 20)], [(5, 5)], [(32, 21)], [(40, 41)]]
    wrote = []
    for k, rows in enumerate(batches):  # each a restart
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.maintain_clustering(stream, lambda batch: batch, target, str(tmp_path / "check"), whole_every=5).awaitTermination()
        number, name = incremental._states(spark, target)[-1]
        assert number == k
        wrote.append((name.partition("=")[0], sorted(tuple(r) for r in spark.read.parquet(f"{target}/{name}").select("member", "cluster_id").collect())))
    assert wrote[1:4] == [("state", [(32, 30)]), ("state", [(20, 10), (21, 10)]), ("state", [(5, 5)])]
    assert [kind for kind, _ in wrote] == ["whole", "state", "state", "state", "state", "whole"]
    want = [[5], [10, 11, 20, 21, 30, 31, 32], [40, 41]]
    assert clusters(incremental.clustering_state(spark, target)) == want
    incremental.forget(spark, target)
    assert [n for _, n in incremental._states(spark, target)] == ["whole=000000000005"] and clusters(incremental.clustering_state(spark, target)) == want


def test_facts(spark):
    mask = lambda d: spark.createDataFrame(list(d.items()), "key long, flag boolean")
    assert flags(facts.combine_masks([mask({1: True, 2: True}), mask({2: False})])) == {1: True, 2: False}
    one = spark.createDataFrame([(1,)], "tx_id long")
    assert facts.combine_sets([one, one]).count() == 2


def test_stream(spark, tmp_path):
    source, folder, state = (str(tmp_path / n) for n in ("in", "facts", "state"))
    schema = "a long, b long"
    spark.createDataFrame([(1, 2), (5, 6)], schema).coalesce(1).write.parquet(source)
    run = lambda: incremental.maintain(spark.readStream.schema(schema).parquet(source), lambda df: df.where("a <> b"), folder, state).awaitTermination()
    run()
    assert clusters(incremental.clustering(spark, folder)) == [[1, 2], [5, 6]]
    spark.createDataFrame([(2, 3), (4, 4), (6, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert clusters(incremental.clustering(spark, folder)) == [[1, 2, 3, 5, 6]]
    run()  # nothing new
    assert incremental.bag(spark, folder).count() == 4
    incremental.compact(spark, folder, str(tmp_path / "new"))
    assert clusters(incremental.clustering(spark, str(tmp_path / "new"))) == [[1, 2, 3, 5, 6]]


def test_stream_masks_and_links(spark, tmp_path):
    source, folder, state = (str(tmp_path / n) for n in ("in", "facts", "state"))
    for rows in ([(1, True), (2, True)], [(2, False)]):
        spark.createDataFrame(rows, "key long, flag boolean").coalesce(1).write.mode("append").parquet(source)
        incremental.maintain(spark.readStream.schema("key long, flag boolean").parquet(source), lambda df: df, folder, state).awaitTermination()
    assert flags(incremental.mask(spark, folder)) == {1: True, 2: False}
    ins = spark.createDataFrame([("x", 0), ("y", 1)], "prev_txid string, prev_vout long")
    outs = spark.createDataFrame([("x", 0, 11)], "txid string, vout long, out_id long")
    linked, left = incremental.relink(ins, outs)
    assert [r["prev_out_id"] for r in linked.collect()] == [11] and [r["prev_txid"] for r in left.collect()] == ["y"]


def test_event_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, event_type string")
    assert sorted(r["n"] for r in incremental.event_counts(rows).collect()) == [1, 2]


def test_round_clusters_once(spark, monkeypatch):
    """A join with a clustering of edges takes the edges, and what needs no placeholder is made before the rounds."""
    g, _ = ledger(spark, CHAIN)
    calls, made = [], clustering.components
    monkeypatch.setattr(clustering, "components", lambda *x: calls.append(1) or made(*x))
    txs, p = (c := Context()).all_txs(), Placeholder(c, Clustering)
    change = txs.outputs().mask(heuristics.naive_change) & txs.unilateral(p.expr).on_outputs()
    p.unify(txs.multi_input().join(change.change_clusters()))
    engine = Engine(g)
    got = clusters(engine.eval(p.expr))
    assert len(calls) == 1 + engine.rounds
    assert got == clusters(clustering.unilateral_fixpoint(g, heuristics.naive_change(g), spark.createDataFrame([], "key long, flag boolean")))
