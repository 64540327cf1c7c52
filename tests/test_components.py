import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from ledgers import clusters

from ledgerloom.operators import clustering, components
from ledgerloom.operators.components import least_labels


def brute(edges):
    groups = []
    for a, b in edges:
        mine = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in mine] + [set().union({a, b}, *mine)]
    return sorted(map(sorted, groups))


def made(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(40)],
    [(7, k) for k in range(30)],
    [(1, 2), (3, 4)],
    [(5, 5)],
    [(1, 2), (1, 2), (2, 1)],
    [(1, 2), (3, 4), (2, 3)],
    [],
])
def test_shapes(spark, edges):
    assert clusters(clustering.cluster(made(spark, edges))) == brute(edges)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=60))
def test_random(spark, edges):
    assert clusters(clustering.cluster(made(spark, edges))) == brute(edges)


def test_many_partitions(spark, monkeypatch):
    """Without the contraction seeing all edges at once."""
    monkeypatch.setattr(components, "FEW", 0)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(400, 500)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert clusters(clustering.cluster(made(spark, edges))) == brute(edges)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_join(spark):
    a, b = clustering.cluster(made(spark, [(1, 2), (5, 6)])), clustering.cluster(made(spark, [(2, 3), (8, 9)]))
    want = [[1, 2, 3], [5, 6], [8, 9]]
    assert clusters(clustering.join(a, b)) == clusters(clustering.join(b, a)) == want
    assert clusters(clustering.join(a, a)) == [[1, 2], [5, 6]]
    empty = clustering.cluster(made(spark, []))
    assert clusters(clustering.join(a, empty)) == [[1, 2], [5, 6]]


def test_labels():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    got = least_labels(a, b, 500)
    for g in brute(zip(a.tolist(), b.tolist(), strict=True)):
        assert {int(got[k]) for k in g} == {g[0]}


def test_rounds_move_few_rows(spark):
    """All rounds together shuffle a few times the first one's rows, and a star's centre is not spread over many."""
    rng = random.Random(5)
    names = rng.sample(range(100_000), 6000)
    edges = [(names[k], names[k + 1]) for k in range(3999)] + [(names[0], k) for k in names[4000:]]
    context = spark.sparkContext

    def written():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    small = {name: spark.conf.get(name) for name in large}
    try:
        for name, value in large.items():
            spark.conf.set(name, value)
        before = written()
        found = components.components(made(spark, edges).repartition(8), few=0).collect()
        assert (written() - before) / len(edges) < 40
    finally:
        for name, value in small.items():
            spark.conf.set(name, value)
    assert {r["node"] for r in found} == set(names) and {r["component"] for r in found} == {min(names)}
