"""Sharding against a plain interleaving, and its defined cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import sharding

DIR = "/root/testdata/sf0.001"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(rows, shards=sharding.SHARDS):
    """(shard, slot) by (id, text, source), repeated rows as a sorted list."""
    strata = defaultdict(list)
    for row in rows:
        i, t, s = row
        key = md5(":".join(str(x) for x in (sharding.SEED, i, md5(t or "")) if x is not None))
        strata[md5(f"{sharding.SEED}:{'n' if s is None else 's' + s}")].append((key, row))
    order = []
    for stratum, members in strata.items():
        members.sort(key=lambda x: x[0])
        phase = int(stratum[:8], 16) / 2**32
        order += [(((r + phase) / len(members)), stratum, key, row) for r, (key, row) in enumerate(members)]
    order.sort(key=lambda x: x[:3])
    out, n = defaultdict(list), len(order)
    for p, (*_, row) in enumerate(order):
        shard = p * shards // n
        out[row].append((shard, p - (shard * n + shards - 1) // shards))
    return {k: sorted(v) for k, v in out.items()}


def found(df, names=("shard", "slot")):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"], r["text"], r["source"]].append((r[names[0]], r[names[1]]))
    return {k: sorted(v) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_as_plain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = found(sharding.interleave(docs))
    assert got == plain(rows)
    counts = Counter(shard for places in got.values() for shard, _ in places)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    per = Counter((source, shard) for (_, _, source), places in got.items() for shard, _ in places)
    whole = Counter(source for _, _, source in rows)
    assert all(abs(per[s, k] - n / 16) <= 2 for s, n in whole.items() for k in range(16))


def test_hot_source_and_small_ones(spark):
    rows = [(k, "x" * (k % 7), "hot") for k in range(4000)] + [(k, "t", f"s{k}") for k in range(4000, 6000)]
    got = found(sharding.interleave(frame(spark, rows), shards=7))
    assert got == plain(rows, 7)
    per = Counter((source == "hot", shard) for (_, _, source), places in got.items() for shard, _ in places)
    assert all(abs(per[True, k] - 4000 / 7) < 40 for k in range(7))  # sources of one row are spread by their phase


def test_nulls_repeats_and_ids_met_twice(spark):
    rows = [(None, None, None), (None, "a", None), (1, "", "s"), (1, None, "s"), (1, "é", "S"), (1, "é", "S"), (1, "é", "S"), (2, "b", "")]
    df = sharding.interleave(frame(spark, rows), shards=3)
    places = sorted(tuple(r) for r in df.select("shard", "slot").collect())
    assert places == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    by_key = lambda x: {(i, t or "", s): v for (i, t, s), v in x.items()}  # noqa: E731  a null text counts as an empty one
    want, got = plain(rows, 3), found(df)
    assert by_key({k: v for k, v in got.items() if k[1]}) == by_key({k: v for k, v in want.items() if k[1]})
    sized = frame(spark, rows).select(sharding.size(F.col("text")).alias("s"), sharding.crc32(F.col("text")).alias("c")).collect()
    assert {tuple(r) for r in sized} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows}


def test_fewer_rows_than_shards_and_none(spark):
    one = sharding.interleave(frame(spark, [(5, "x", "s")])).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]
    empty = sharding.interleave(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "source", "shard", "slot"]


def test_columns_of_the_same_names(spark):
    df = frame(spark, [(k, "t", "s") for k in range(20)]).withColumn("Shard", F.lit("old")).withColumn("part", F.lit(1)).withColumn("a.b", F.create_map(F.lit("k"), F.col("doc_id")))
    out = sharding.interleave(df, shards=4)
    assert out.columns == ["doc_id", "text", "source", "part", "a.b", "shard", "slot"]
    assert Counter(r["shard"] for r in out.collect()) == {0: 5, 1: 5, 2: 5, 3: 5}


def test_no_python_in_the_plan(spark):
    plan = sharding.interleave(frame(spark, [(1, "t", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_files(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source")
    sharded = sharding.interleave(docs)
    sharding.write(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert found(back) == found(sharded)
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
