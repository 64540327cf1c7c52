"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    """(item, rank, doc, score) by scoring every document; a null id is last of equals."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, whole = len(counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, some in asked.items():
        scored = []
        for i, c, size in counts:
            m = 100 - 90 + 90 * size * n // whole
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in some if t in c)
            if score:
                scored.append((-score, math.inf if i is None else i))
        for rank, (score, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if i == math.inf else i, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item", "rank", "doc", "score").collect()), key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 4)
    monkeypatch.setattr(lexical, "SEEDS", 1)


def words(rng, n, most=60):
    return " ".join(f"w{int(most * rng.random() ** 3)}" for _ in range(n))


def test_as_plain_over_many_blocks_and_ties(spark, small_blocks):
    rng = random.Random(5)
    docs = [(k, words(rng, rng.randrange(1, 40))) for k in range(300)]
    docs += [(k, "w1 w2 w50 rare") for k in range(400, 460)]  # equal scores, more of them than are returned
    docs += [(999, docs[3][1] + " passage that is long")] * 3
    items = [(f"i{k}", words(rng, 12)) for k in range(12)] + [("rare", "Rare W1"), ("none", "nowhere"), ("copy", docs[3][1]), ("empty", "- . !")]
    a, b = frames(spark, docs, items)
    assert found(lexical.ranked(a.repartition(5), b)) == plain(docs, items)


def test_chunks_of_items(spark, small_blocks, monkeypatch):
    rng = random.Random(7)
    docs = [(k, words(rng, 20)) for k in range(60)]
    items = [(f"i{k}", words(rng, 9)) for k in range(9)]
    a, b = frames(spark, docs, items)
    want = plain(docs, items, 3)
    monkeypatch.setattr(lexical, "ITEMS", 2)
    assert found(lexical.ranked(a, b, top=3)) == want
    monkeypatch.setattr(lexical, "ITEMS", 100)
    monkeypatch.setattr(lexical, "CHUNK", 10)
    assert found(lexical.ranked(a, b, top=3)) == want


def test_nulls_repeats_and_long_texts(spark, small_blocks):
    long = "alpha beta " * 200_000 + "ömega"
    docs = [(1, None), (2, ""), (3, "... !!"), (4, "Alpha"), (4, "Alpha"), (None, "alpha"), (5, long), (6, "ÖMEGA"), (7, "ömega9 ömega"), (-3, "beta")]
    items = [("a", "ALPHA"), ("a", "beta"), (None, "ömega"), ("n", None), ("x", "alpha alpha")]
    a, b = frames(spark, docs, items)
    got = found(lexical.ranked(a, b))
    assert got == plain(docs, items)
    assert [r[2] for r in got if r[0] == "x"] == [5, 4, 4, None]


def test_long_documents_make_own_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ENTRIES", 50)
    rng = random.Random(1)
    docs = [(k, words(rng, 400 if k % 5 == 0 else 5, 500)) for k in range(40)]
    items = [("q", words(rng, 30, 500))]
    a, b = frames(spark, docs, items)
    assert found(lexical.ranked(a, b)) == plain(docs, items)


def test_empty_tables(spark):
    for docs, items in (([], [("a", "x")]), ([(1, "x")], []), ([(1, "!")], [("a", "x")]), ([(1, None)], [("a", None)])):
        assert found(lexical.ranked(*frames(spark, docs, items))) == []


def test_other_columns(spark):
    a, b = frames(spark, [(1, "x y"), (2, "x")], [("q", "x y")])
    a = a.withColumn("block", F.lit(1)).withColumn("IDS", F.lit("c")).withColumnRenamed("doc_id", "my.id")
    assert [r[:3] for r in found(lexical.ranked(a, b.withColumn("term", F.lit(0)), id="my.id"))] == [("q", 1, 1), ("q", 2, 2)]


def test_index_is_kept_and_loaded(spark, tmp_path):
    rng = random.Random(2)
    docs, items = [(k, words(rng, 15)) for k in range(50)], [("q", "w1 w2 w3")]
    a, b = frames(spark, docs, items)
    lexical.build(a, str(tmp_path / "index"))
    assert found(lexical.search(lexical.load(spark, str(tmp_path / "index")), b)) == plain(docs, items)


def test_whole_numbers_beyond_doubles(spark, small_blocks, monkeypatch):
    rng = random.Random(9)
    docs, items = [(k, words(rng, 15)) for k in range(40)], [("q", words(rng, 20))]
    monkeypatch.setattr(lexical.Chunk, "exact", property(lambda self: __import__("numpy").int64))
    assert found(lexical.ranked(*frames(spark, docs, items))) == plain(docs, items)
    import numpy as np

    size = np.array([10**12, 3])  # 90 * length * documents is beyond 64 bits
    assert lexical._parts(np.array([7, 7]), size, 10**9, 10**12).tolist() == [7 * 10**9 // (7000 + 8 * (10 + 90 * int(x) * 10**9 // 10**12)) for x in size]


def test_blocks_below_the_threshold_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 8)
    docs = [(k, "common " + ("special term " * 5 if k < 16 else f"f{k} g{k}")) for k in range(2000)]
    a, b = frames(spark, docs, [("q", "special common term")])
    index = lexical.build(a.repartition(1).sortWithinPartitions("doc_id"), lexical.index_folder(spark))
    assert index.blocks.count() == 250
    scored = spark.sparkContext.accumulator(0)
    assert found(lexical.search(index, b, scored=scored)) == plain(docs, [("q", "special common term")])
    assert scored.value == 2 + 2  # of the first blocks and of all: those without the term are below what two blocks have shown
