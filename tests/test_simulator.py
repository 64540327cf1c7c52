import pytest

from ledgerloom.ledger import Ledger
from ledgerloom.operators import metrics
from ledgerloom.simulator.config import parse
from ledgerloom.simulator.world import Plan, World

HEAD = "[simulation]\nseed = {seed}\nmax_timestep = {steps}\nnum_payment_obligations = {n}\n"
TYPE = '[[wallet_types]]\nname = "{name}"\ncount = {count}\nstrategies = ["{strategy}"]\nscript_type = "{script}"\n[wallet_types.scorer]\nprivacy_weight = {privacy}\npayment_obligation_weight = {weight}\n'


def world(*types, seed=42, steps=20, n=10):
    text = HEAD.format(seed=seed, steps=steps, n=n) + "".join(TYPE.format(**({"name": "w", "script": "p2tr", "privacy": 0.0, "weight": 1.0} | t)) for t in types)
    return World(parse(text)).run()


@pytest.mark.parametrize("strategy", ["UnilateralSpender", "BatchSpender", "Consolidator"])
def test_no_payment_is_missed(strategy):
    w = world({"count": 5, "strategy": strategy})
    assert len(w.obligations) == 10
    handled = {o for x in w.wallets for o in x.handled}
    # wallets that spend all coins at once wait for the change, so what falls due at the end may stay open
    assert handled >= {o.id for o in w.obligations if strategy != "Consolidator" or o.deadline < 12}


def test_same_seed_same_world():
    make = lambda seed: [(t.inputs, t.outputs) for t in world({"count": 4, "strategy": "UnilateralSpender"}, seed=seed).txs]
    assert make(1) == make(1) != make(2)


def test_joint_transactions():
    w = world({"count": 4, "strategy": "MultipartyStrategy", "weight": 2.0}, {"count": 1, "strategy": "AggregatorStrategy", "weight": 0.0}, steps=25, n=8)
    done = [s for s in w.sessions if s.tx is not None]
    assert done
    for s in done:
        assert len({w.coins[o].wallet for o in w.txs[s.tx].inputs}) > 1
        assert sorted(w.txs[s.tx].inputs) == sorted(o for c in s.coins.values() for o in c)


def test_plans_of_many_payments(monkeypatch):
    w = world({"count": 2, "strategy": "BatchSpender"}, n=2)
    monkeypatch.setattr(w, "due", lambda _: list(range(10)))
    monkeypatch.setattr(w, "selections", lambda _, some: [Plan("pay", tuple(some))])
    plans = w.powerset_plans(w.wallets[0])
    assert len(plans) == len(set(plans)) == 2**10 - 1
    assert {len(p.obligations) for p in plans} == set(range(1, 11))


def test_selection_is_the_cheapest():
    """Branch and bound against all subsets."""
    import random
    from itertools import combinations

    from ledgerloom.simulator.config import WEIGHTS
    from ledgerloom.simulator.world import DUST, Coin

    w = world({"count": 2, "strategy": "BatchSpender", "script": "p2wpkh"}, n=2)
    me, rng = w.wallets[0], random.Random(2)
    for _ in range(30):
        coins = [Coin((900, k), 0, rng.randrange(500, 9000)) for k in range(rng.randrange(1, 8))]
        w.coins |= {c.outpoint: c for c in coins}
        outputs = [(1, rng.randrange(300, 9000)) for _ in range(rng.randrange(1, 3))]

        def cost(some, outputs=outputs):
            if w._change(me, list(some), outputs) is None:
                return float("inf")
            left = sum(c.amount for c in some) - sum(a for _, a in outputs)
            with_change = w._fee(list(some), [*outputs, (0, 0)])
            return with_change + -(-WEIGHTS["p2wpkh"][0] // 4) if left - with_change > DUST else left

        best = min(cost(s) for n in range(1, len(coins) + 1) for s in combinations(coins, n))
        chosen = w._cheapest(me, coins, outputs)
        assert (cost(chosen) if chosen else float("inf")) == best


def test_dump():
    w = world({"count": 3, "strategy": "UnilateralSpender"}, steps=6, n=3)
    text = w.dump()
    assert text.startswith("step 6: ") and text.count("wallet ") == 3 and f"block {len(w.blocks) - 1}: " in text


@pytest.mark.parametrize("change", ['strategies = ["Nobody"]', "count = 0"])
def test_bad_config(change):
    text = HEAD.format(seed=1, steps=5, n=1) + TYPE.format(name="w", count=1, strategy="BatchSpender", script="p2tr", privacy=0, weight=1)
    old = 'strategies = ["BatchSpender"]' if "strategies" in change else "count = 1"
    with pytest.raises(ValueError):
        parse(text.replace(old, change))


def test_metrics_of_a_world(spark):
    w = world({"count": 4, "strategy": "UnilateralSpender"})
    f = w.frames(spark)
    key = "tx_id * 1000 + vout"
    outs = f["txout"].selectExpr(f"{key} AS out_id", "tx_id", "vout", "value", "wallet_id AS spk", "4 AS output_type", "wallet_id")
    ins = f["txin"].selectExpr("tx_id * 1000 + vin AS in_id", "tx_id", "vin", "prev_tx_id * 1000 + prev_vout AS prev_out_id", "0L AS sequence")
    g = Ledger(f["tx"].selectExpr("tx_id", "0L AS locktime", "block_height"), ins, outs)
    utxos = metrics.utxo_set(g)
    assert utxos.count() == len(w.confirmed)
    sized = metrics.fees_and_weights(g)
    assert {r["tx_id"]: (r["fee"], r["weight"]) for r in sized.where("NOT is_coinbase").collect()} == {t.id: (t.fee, t.weight) for t in w.txs if t.inputs}
    assert metrics.double_spends(g).count() == 0
    fees = [t.fee for t in w.txs if t.inputs]
    assert metrics.average_fee(sized).first()[0] == sum(fees) // len(fees)
    by = {}
    for o in w.confirmed:
        by.setdefault(w.coins[o].wallet, []).append(w.coins[o].amount)
    for r in metrics.wallet_stats(utxos, "wallet_id").collect():
        amounts = sorted(by[r["wallet_id"]])
        rank = lambda p: amounts[max(1, -(-p * len(amounts) // 100)) - 1]
        assert (r["n_utxos"], r["p50"], r["p90"]) == (len(amounts), rank(50), rank(90))
    assert "digraph" in w.dot()
