"""Sub-transactions: lists by search, counts and lists by joins, each against the other."""

import random
from itertools import combinations

from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.operators import balances, subsets
from ledgerloom.operators.subsets import mappings, non_derived, partitions, subset_sums


def test_partitions():
    found = {tuple(sorted(tuple(sorted([1, 3, 18][i] for i in b)) for b in p)) for p in partitions([1, 3, 18], subset_sums([3, 4, 19]))}
    assert found == {((1, 18), (3,)), ((1, 3, 18),)}


def test_known_transactions():
    unmixed = non_derived([21, 12, 36, 28], [25, 8, 50, 14])
    assert len(unmixed) == 1 and len(unmixed[0]) == 2
    assert len(non_derived([21, 12, 36, 28], [25, 8, 31, 19, 14])) == 2
    assert mappings([100, 50], [80, 70]) == [(((0, 1), (0, 1)),)]
    assert mappings([100], [90]) == []


def test_mappings_balance():
    ins, outs = [5, 3, 2, 7], [4, 4, 2, 7]
    for m in mappings(ins, outs):
        assert sorted(i for a, _ in m for i in a) == sorted(i for _, b in m for i in b) == [0, 1, 2, 3]
        assert all(sum(ins[i] for i in a) == sum(outs[i] for i in b) for a, b in m)


def ambiguous_subsets(ins, outs, depth=balances.DEPTH):
    valid = subset_sums(outs)
    return sum(sum(c) in valid for n in range(1, min(depth, len(ins) - 1) + 1) for c in combinations(ins, n))


def spending(spark, pairs):
    """A ledger with a transaction for each (ins, outs), and the number of each."""
    txs = [([*ins], []) for ins, _ in pairs]
    for k, (ins, outs) in enumerate(pairs, 1):
        txs.append(([*outs], [(k, v) for v in range(len(ins))]))
    return ledger(spark, txs)[0], {len(pairs) + k: pair for k, pair in enumerate(pairs, 1)}


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_zero_sums_are_no_blocks():
    assert subset_sums([0, 0]) == set()


def test_joins_as_the_lists(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(80):
        ins, outs = ([rng.choice([0, 1, 2, 3, 5, 7]) for _ in range(rng.randint(1, 4))] for _ in range(2))
        if k % 4:
            (outs if sum(ins) > sum(outs) else ins).append(abs(sum(ins) - sum(outs)))
        pairs.append((ins, outs))
    g, txs = spending(spark, pairs)
    assert counts(balances.mapping_counts(g, derived=True)) == {k: len(mappings(*p)) for k, p in txs.items()}
    assert counts(balances.mapping_counts(g, derived=False)) == {k: len(non_derived(*p)) for k, p in txs.items()}
    assert counts(balances.partition_counts(g)) == {k: sum(1 for _ in partitions(i, subset_sums(o))) for k, (i, o) in txs.items()}
    assert counts(balances.sum_counts(g)) == {k: len(subset_sums(o)) for k, (_, o) in txs.items()}
    for depth in (1, 2, 8):
        assert counts(balances.ambiguous(g, depth)) == {k: ambiguous_subsets(i, o, depth) for k, (i, o) in txs.items()}
    for derived, plain in ((True, mappings), (False, non_derived)):
        got = {}
        for r in balances.mapping_lists(g, derived).collect():
            got.setdefault(r["tx_id"], []).append(tuple((tuple(b["ins"]), tuple(b["outs"])) for b in r["mapping"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: m for k, p in txs.items() if (m := plain(*p))}


def test_many_coins(spark):
    """Powers of two, whose counts are known, beside many equal amounts."""
    powers = [1 << k for k in range(7)]
    pairs = [(powers, [*powers, *(1 << k for k in range(20, 25))]), ([3, 4], [1] * 9), ([3 << 10, 5 << 10], [1 << k for k in range(13)]), ([7], [9] * 70), (powers, powers), ([2] * 63, [1])]
    g, txs = spending(spark, pairs)
    of = lambda df: [n for _, n in sorted(counts(df).items())]
    assert of(balances.ambiguous(g)) == [126, 2, 2, 0, 126, 0]
    assert of(balances.sum_counts(g)) == [2**12 - 1, 9, 2**13 - 1, 70, 2**7 - 1, 1]
    assert of(balances.partition_counts(g)) == [877, 2, 1, 0, 877, None]  # each set partition; sixty-three coins are beyond a mask
    assert of(balances.mapping_counts(g, derived=True)) == [0, 0, 0, None, 877, None]
    assert of(balances.mapping_counts(g, derived=False)) == [0, 0, 0, None, 1, None]


def test_one_transaction_is_dealt_over_tasks(spark):
    """Twenty-four coins: the rows of either half lie in many partitions."""
    rng = random.Random(2)
    ins = [rng.randrange(1, 10**6) for _ in range(12)]
    outs = [rng.randrange(1, 10**6) for _ in range(11)]
    outs.append(max(1, sum(ins) - sum(outs)))
    g, _ = spending(spark, [(ins, outs)])
    a, b = balances._masks(balances.coins(g)[0])
    c, d = balances._masks(balances.coins(g)[1])
    assert a.count() == b.count() == c.count() == d.count() == 64
    pairs = balances._balanced((a, b), (c, d))
    found = {(r["a_mask"] + r["b_mask"], r["c_mask"] + r["d_mask"]) for r in pairs.collect()}
    sums = {}
    for m in range(1, 1 << 12):
        sums.setdefault(sum(ins[k] for k in range(12) if m >> k & 1), []).append(m)
    want = {(a, m) for m in range(1, 1 << 12) for a in sums.get(sum(outs[k] for k in range(12) if m >> k & 1), ())}
    assert found == want
    left = balances._salted(balances._named(a, "a"), balances._named(c, "c"), ["tx_id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = left.withColumn("apart", F.expr("a_total - c_total")).repartition("tx_id", "apart")
        assert dealt.count() == 4096 and dealt.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_own_metric(spark):
    g, txs = spending(spark, [([21, 12, 36, 28], [25, 8, 50, 14]), ([5, 5], [5, 5])])
    got = counts(balances.privacy(g, (lambda n, most: most * (n + 1), lambda n, most: F.lit(0.5)), budget=2.0))
    assert got == {k: 2.0 * (ambiguous_subsets(*p) + 1) + 0.5 for k, p in txs.items()}


def test_table_function(spark):
    """In SQL with a partitioned table, and in a lateral join's place by DataFrames."""
    g, txs = spending(spark, [([21, 12, 36, 28], [25, 8, 31, 19, 14]), ([5, 5], [5, 5]), ([4], [3])])
    ins, outs = balances.coins(g)
    coins = ins.select("tx_id", F.lit(0).alias("side"), "place", "v").union(outs.select("tx_id", F.lit(1), "place", "v"))
    coins.createOrReplaceTempView("some_coins")
    subsets.register(spark)
    rows = spark.sql("SELECT * FROM mapping_blocks(TABLE(some_coins) PARTITION BY tx_id)").collect()
    assert sorted(rows) == sorted(subsets.mapping_blocks(coins).collect())
    want = {(k, "".join(f"({','.join(map(str, a))}>{','.join(map(str, b))})" for a, b in m)) for k, p in txs.items() for m in mappings(*p)}
    assert {(r["tx_id"], r["mapping"]) for r in rows} == want
    assert all(r["amount"] == sum(txs[r["tx_id"]][0][int(i)] for i in r["ins"].split(",")) for r in rows)


def test_empty(spark):
    g, _ = ledger(spark, [([5], [])])
    for df in (balances.sum_counts(g), balances.ambiguous(g), balances.partition_counts(g), balances.mapping_counts(g, True), balances.mapping_lists(g, False)):
        assert df.collect() == []
