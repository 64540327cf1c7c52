import numpy as np
import pytest

from ledgerloom.llm import caps


def brute(rows, cosine=0.9):
    vectors = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            vectors[k] = x / np.linalg.norm(x)
    links = {k: [j for j in vectors if j != k and len(vectors[j]) == len(vectors[k]) and vectors[j] @ vectors[k] >= cosine] for k in vectors}
    label = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = label | {k: min([label[k], *(label[j] for j in links[k])]) for k in links}
        if new == label:
            return [(i, len(links.get(k, [])), label[k]) for k, (i, _) in enumerate(rows)]
        label = new


def rows(d=64):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((6, d))
    near = [b + rng.standard_normal(d) * s for b in base for s in (0.05, 0.15, 0.3, 0.45) for _ in range(6)]
    out = [v.tolist() for v in [*near, *rng.standard_normal((80, d))]]
    out += [out[0], out[0], [2 * x for x in out[0]], None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), out[0][: d // 2], [1e200] * d, [1e-200] * d]
    return [*((k, v) for k, v in enumerate(out)), (None, out[0]), (0, out[0])]


@pytest.mark.parametrize("d", [64, 8, 100])
def test_against_brute_force(spark, d):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows(d)], "vec_id long, embedding array<double>, filters string")
    got = caps.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == sorted(x for x in brute(rows(d)) if x[0] is not None)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(caps, "LEAST", 2)
    monkeypatch.setattr(caps, "MOST", 4)
    test_against_brute_force(spark, 64)


@pytest.mark.parametrize("n", [1000, 10_000, 50_000, 200_000])
def test_recall(n):
    """Of random pairs at the threshold, nearly all share a filter, and unrelated vectors share fewer the more there are."""
    f = caps.Filters.of(n)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    mine = caps.decode(x, f)
    hits = [len(np.intersect1d(a, b)) > 0 for a, b in zip(mine, caps.decode(y, f), strict=True)]
    assert np.mean(hits) >= 0.99
    _, k = np.unique(np.concatenate(mine), return_counts=True)
    assert (k * (k - 1)).sum() / (400 * 399) * n < 60


@pytest.mark.parametrize("f", dict.fromkeys(caps.Filters.of(4000 * 4**k) for k in range(16)), ids=str)
def test_recall_of_every_level(f):
    """Whatever the number of vectors, pairs at the threshold share a filter."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x, f), caps.decode(y, f), strict=True)]
    assert np.mean(hits) >= 0.99


@pytest.mark.parametrize("d", [8, 32, 256, 768])
@pytest.mark.parametrize("n", [1000, 1 << 24])
def test_recall_of_other_dimensions(d, n):
    f = caps.Filters.of(n)
    rng = np.random.default_rng(13)
    x = rng.standard_normal((200, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((200, d))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x, f), caps.decode(y, f), strict=True)]
    assert np.mean(hits) >= 0.98


def test_a_cone_is_no_cluster(spark):
    """Vectors that are all loosely alike, as real embeddings are: only those that are alike enough are linked."""
    rng = np.random.default_rng(9)
    axis = rng.standard_normal(64)
    base = [axis * 1.6 + rng.standard_normal(64) for _ in range(150)]
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *(v + 0.05 * rng.standard_normal(64) for v in base[:20])])]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute(rows))


def test_decoding_is_complete():
    """Exactly the filters that a vector exceeds."""
    f = caps.Filters.of(5000)
    x = np.random.default_rng(3).standard_normal((3, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables, _ = caps._code(64, f)
    for v, got in zip(x, caps.decode(x, f), strict=True):
        want = []
        for t, (a, b) in enumerate(tables):
            p, q = np.nonzero((v @ a)[:, None] + v @ b >= f.eta / 8)
            want += ((t * f.words + p) * f.words + q).tolist()
        assert set(want) == set(got.tolist())


def test_empty(spark):
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
