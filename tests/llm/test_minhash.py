import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import minhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(1, len(w)))))


def brute(rows, size, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}


def family(rng, n, words=60, edits=6):
    """Near copies of one text, of similarities on both sides of the threshold."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rows():
    rng = random.Random(5)
    texts = [t for k in range(12) for t in family(rng, 14, edits=4 + k)]
    texts += [" ".join(f"r{rng.randrange(3000)}" for _ in range(30)) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "one  Two", "one two three", texts[0].upper(), texts[0], "x y " * 20_000, "x y " * 20_001]
    out = list(enumerate(texts))
    return [*out, out[3], (None, texts[0]), (None, None)]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    want, sizes = brute(rows(), size)
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=size).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_small_blocks(spark, monkeypatch):
    """Buckets over several blocks give the same."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    test_against_brute_force(spark, 2)


def test_fetch_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1)
    test_against_brute_force(spark, 2)


def test_drop(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, `__key` string, rep int")
    got = minhash.drop_near_duplicates(df)
    want, _ = brute(rows(), 5)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted([i for i in want if want[i] == i] + [3] * (want[3] == 3))


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates():
    """XOR counts follow the similarity, and pairs at the threshold stay under the limit."""
    rng = np.random.default_rng(2)
    counts = []
    for _ in range(150):
        base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, 111, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([base[:889], o])) for o in own]  # 889 of 1111: 0.8
        at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        s = minhash.sketches(minhash.signatures(np.concatenate(sets), at))
        counts.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
    assert max(counts) <= minhash.far() and 38 < np.mean(counts) < 54


def test_long_sets_have_the_samples_of_short_runs():
    sets = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64))
    whole = minhash.signatures(sets, np.array([0, len(sets)]))
    k = 17
    assert whole[k, 0] == (sets * minhash._MULTIPLY[k] + minhash._ADD[k]).min()


def test_shingles_of_short_texts():
    sets, at = minhash.shingles(pa.array(["a", None, "a b", "A  b", "a b c", "b a"]), 3)
    n = np.diff(at).tolist()
    assert n == [1, 0, 1, 1, 1, 1] and sets[at[2]] == sets[at[3]] and len(np.unique(sets)) == 4
