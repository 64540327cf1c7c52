import hashlib
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate as d

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(i or "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables():
    rng = random.Random(8)
    some = lambda n, k=40: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(str(k), some(rng.randrange(8, 60))) for k in range(25)]
    items += [("short", "Lone Pair"), ("one", "uniqueword"), ("none", "..."), ("null", None), ("dup", items[0][1]), ("0", items[1][1]), (None, "null id item here"), ("rep", "a b " * 12)]
    docs = []
    for k in range(80):
        text = some(rng.randrange(5, 80))
        if k % 4 == 0:
            x = items[rng.randrange(25)][1].split()
            a = rng.randrange(max(1, len(x) - 9))
            text += " " + ", ".join(x[a : a + rng.randrange(8, 30)]).upper() + " " + some(9)
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "the lone-pair of"), (103, "Uniqueword"), (104, "null id item here"), (105, "a b " * 40), (106, ("w1 " * 9 + "\n") * 9000), docs[0]]
    return docs, items


@pytest.mark.parametrize(("block", "shard"), [(d.BLOCK_BYTES, d.SHARD_BYTES), (600, 500)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    docs, items = tables()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, longest string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found, names = d.matches(df, bench)
    assert found.columns[:3] == df.columns and names[:5] == [f.name for f in d.FOUND][:5] and names[5] != "longest"
    rows = found.collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        if r["doc_id"] == 106:
            assert r["n_hit"] == 0 and r["n_words"] == 81_000
            continue
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items)
        longest, at, item = r[names[5]], r[names[6]], r[names[7]]
        if r["contaminated"]:  # the words are those of the item
            w = words(texts[r["doc_id"]])[at : at + longest]
            assert any(words(t)[k : k + longest] == w for i, t in items if (i or "") == item for k in range(len(words(t))))
        else:
            assert longest == 0 and at is None and item is None
    kept = d.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if not r["contaminated"])


def test_longest_match(spark):
    item = " ".join(f"i{k}" for k in range(30))
    doc = "pre " + " ".join(f"i{k}" for k in range(3, 28)) + " mid " + " ".join(f"i{k}" for k in range(12))
    found, _ = d.matches(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string"))
    r = found.first()
    assert (r["longest"], r["longest_at"], r["longest_item"], r["n_hit"]) == (25, 1, "q", 37)


def test_empty_tables(spark):
    docs, items = tables()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert d.matches(df.limit(0), bench)[0].count() == 0
    assert not any(r["contaminated"] for r in d.matches(df, bench.limit(0))[0].collect())


def test_suffix_array():
    rng = np.random.default_rng(3)
    words_ = np.append(rng.integers(0, 3, 300), 0).astype(np.int32)
    starts = np.flatnonzero(words_ > 0)
    got = d.suffix_array(words_, starts, 16)
    run = lambda s: tuple(words_[s : s + int(np.argmax(words_[s:] == 0))])[:16]
    assert [run(s) for s in got] == sorted(run(s) for s in starts)
