"""Each rule of a ledger broken once, and a stream's windows over events that come late."""

from datetime import datetime, timezone

from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.operators import chain, clustering, metrics
from ledgerloom.streaming import incremental


def broken(g):
    return {r["rule"]: r["n_violations"] for r in metrics.violations(g).collect()}


def test_rules(spark):
    none = dict.fromkeys(("double_spend", "spends_later", "unspendable", "creates_value"), 0)
    start = ([9, 9], [])
    assert broken(ledger(spark, [start, ([9], [(1, 0)])])[0]) == none
    assert broken(ledger(spark, [start, ([9], [(1, 0)]), ([1], [(1, 0)])])[0]) == none | {"double_spend": 1}
    assert broken(ledger(spark, [([1], [(2, 0)]), ([9], [])])[0]) == none | {"spends_later": 1}
    assert broken(ledger(spark, [start, ([9], [(1, 0)])], types={(1, 0): 5})[0]) == none | {"unspendable": 1}
    assert broken(ledger(spark, [start, ([10], [(1, 0)])])[0]) == none | {"creates_value": 1}
    assert broken(ledger(spark, [start, ([10], [(1, 0), (7, 7)])])[0]) == none  # an input that is not known may hold the rest


def test_rounds_as_one_task(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 7] + [(3, 30), (50, 50)], "a long, b long")
    assert clustering.equal(clustering.cluster(edges), clustering.cluster(edges, few=0))
    heads = spark.createDataFrame([(bytes([k]), bytes([k - 1])) for k in range(1, 30)] + [(bytes([99]), bytes([5]))], "block_hash binary, prev_hash binary")
    rows = lambda local: sorted((bytes(r["block_hash"]), r["height"]) for r in chain.heights(heads, local=local).collect())
    assert rows(0) == rows(None) and len(rows(0)) == 29


def test_sessions_and_overlapping_windows(spark):
    at = lambda h, m: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    rows = [(1, at(1, 0), 7, "a", 20.0), (2, at(1, 29), 7, "a", 1.0), (3, at(1, 59), 7, "b", 1.0), (4, at(1, 20), 8, "a", 1.0), (5, at(1, 58), 7, "a", 99.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    found = incremental.sessions(events).select("user_id", F.date_format("start", "HH:mm"), F.date_format("finish", "HH:mm"), "n", "last_event").collect()
    assert sorted(map(tuple, found)) == [(7, "01:00", "02:29", 4, 5), (8, "01:20", "01:50", 1, 4)]  # the last one to come joins two sessions
    found = incremental.sliding_counts(events).select(F.date_format("start", "dd HH"), "event_type", "n", "n_large").collect()
    assert sorted(map(tuple, found)) == sorted((h, t, n, k) for h in ("31 23", "01 00", "01 01") for t, n, k in (("a", 4, 2), ("b", 1, 0)))
