"""Keyed state over a stream of parts: batches, restarts, timers, and a time to live."""

import time
from datetime import datetime, timezone

import pytest
from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.operators import heuristics
from ledgerloom.streaming import keyed


def at(hour):
    return datetime(2024, 1, 1, hour, tzinfo=timezone.utc)


def row(tx, hour, n_in, n_out, locktime=0):
    return (tx, at(hour), keyed.ROW, None, n_in, n_out, locktime)


def out(tx, hour, value):
    return (tx, at(hour), keyed.OUT, value, None, None, None)


def inp(tx, hour, sequence):
    return (tx, at(hour), keyed.IN, sequence, None, None, None)


def tick(hour):
    return (None, at(hour), keyed.TICK, None, None, None, None)


@pytest.fixture
def run(spark, tmp_path):
    """Adds a batch of parts, runs the stream from where it was, gives the rows of each new fact table."""
    source = tmp_path / "parts"
    source.mkdir()
    done = set()

    def step(*batches, **options):
        for rows in batches:
            time.sleep(0.01)  # files are taken by their time
            spark.createDataFrame(rows, keyed.PART).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(keyed.PART).option("maxFilesPerTrigger", 1).parquet(str(source))
        told = keyed.facts(stream, 3_600_000, **({"late": "10 minutes"} | options))
        keyed.maintain(told, str(tmp_path / "facts"), str(tmp_path / "checkpoint"), clock="keep_ms" in options).awaitTermination()
        new = sorted(p for p in (tmp_path / "facts").iterdir() if p not in done and p.is_dir())
        done.update(new)
        return [{r["key"]: r for r in spark.read.parquet(str(p)).collect()} for p in new]

    step.latest = lambda: {r["key"]: r for r in keyed.latest(spark, str(tmp_path / "facts")).collect()}
    return step


def test_batches_touch_their_keys_only(run):
    first, second = run(
        [row(1, 1, 1, 2), out(1, 1, 50), inp(2, 1, 5), inp(2, 1, 0xFFFFFFFF), out(3, 1, 7), out(3, 1, 7)],
        [out(1, 1, 60), inp(1, 1, 0xFFFFFFFF), row(2, 1, 2, 0, 9)],
    )[:2]
    assert set(first) == {1, 2, 3} and set(second) == {1, 2}
    assert [first[k]["complete"] for k in (1, 2, 3)] == [False] * 3 and second[1]["complete"] and second[2]["complete"]
    assert second[1]["total"] == 110 and not second[1]["rbf"] and second[2]["rbf"] and second[2]["bip68_with_locktime"]  # told by inputs that came before the row
    third = run([out(3, 1, 7), out(3, 1, 8), out(1, 1, 50)])  # a restart; the last part comes again
    assert set(third[0]) == {3} and third[0][3]["coinjoin"] and third[0][3]["n_out"] == 4
    assert not run.latest()[1]["coinjoin"] and run.latest()[1]["n_out"] == 2


def test_timer_tells_what_stays_incomplete(run):
    first, *rest = run([row(1, 1, 0, 1), out(1, 1, 5), out(2, 1, 5), row(3, 4, 0, 2), out(3, 4, 1)])
    assert set(first) == {1, 2, 3} and not any(r["expired"] for r in first.values())
    assert [(r["key"], r["expired"], r["n_out"]) for b in rest for r in b.values()] == [(2, True, 1)]  # 1 was complete, 3 has its hour
    rest = [r for b in run([out(3, 5, 9), tick(9)]) for r in b.values()]
    assert [(r["key"], r["complete"], r["expired"]) for r in rest] == [(3, True, False)]
    late = [r for b in run([out(2, 1, 6)]) for r in b.values()]
    assert late == []  # behind the watermark
    assert {k: (r["complete"], r["expired"]) for k, r in run.latest().items()} == {1: (True, False), 2: (False, True), 3: (True, False)}


def test_time_to_live(run):
    run([out(1, 1, 5)], late=None, keep_ms=600_000)
    second = run([out(1, 1, 5), row(1, 1, 0, 2)], late=None, keep_ms=600_000)
    assert second[0][1]["n_out"] == 2 and second[0][1]["complete"]


def test_state_that_has_lived_begins_anew(run):
    run([out(1, 1, 5)], late=None, keep_ms=1)
    time.sleep(0.05)
    assert run([out(1, 1, 5)], late=None, keep_ms=1)[0][1]["n_out"] == 1


def test_time_to_live_goes_by_the_clock(spark):
    with pytest.raises(ValueError, match="clock"):
        keyed.facts(spark.readStream.format("rate").load(), 1, keep_ms=1)


def test_as_the_heuristics(spark, run):
    g, _ = ledger(spark, [([5, 5, 5], []), ([9], [(1, 0), (1, 1)]), ([5, 5], [(1, 2)])], locktimes={2: 7}, sequence=5)
    rows = [tuple(r) for r in keyed.parts(g, F.lit(at(2))).collect()]
    run(rows[::2], rows[1::2])
    got = run.latest()
    for name, mask in (("rbf", heuristics.rbf_mask(g)), ("coinjoin", heuristics.is_coinjoin(g))):
        assert {k: r[name] for k, r in got.items()} == {r["key"]: r["flag"] for r in mask.collect()}
    assert {k: r["bip68_with_locktime"] for k, r in got.items()} == {r["tx_id"]: r["bip68_with_locktime"] for r in heuristics.locktime_flags(g).collect()}
    assert all(r["complete"] for r in got.values())


def test_state_is_asked_once_for_a_run(spark, run, tmp_path):
    """Transactions of one run share a state: a batch of many looks up and writes few keys."""
    told = [b for b in run([out(t, 1, 5) for t in range(keyed.RUN)], [row(t, 1, 0, 2) for t in range(keyed.RUN)], [out(t, 1, 5) for t in range(keyed.RUN)]) if b]
    assert [len(b) for b in told] == [keyed.RUN] * 3 and all(r["complete"] and not r["coinjoin"] for r in told[2].values())
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "checkpoint"))
    assert state.where("value IS NOT NULL").count() == 1
