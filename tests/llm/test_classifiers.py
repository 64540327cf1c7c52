import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.learning import Isotonic, Trees, is_held_out, labelled_sample

SCHEMA = "doc_id long, text string"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ko", "mi", "re", "su"]) for _ in range(rng.randrange(1, 4)))
    docs, toxic, good = [], [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 120))]
        bad, low = i % 5 == 0, i % 3 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grumpf", "bleck", "snorf"])
        text = " ".join(w).capitalize() + "."
        if low:
            text = " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text))
        toxic.append((i, int(bad)))
        good.append((i, int(not low)))
    return docs, toxic, good


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    docs, toxic, good = corpus()
    truth = dict(toxic if label == "toxic" else good)
    # labels of the held-out rows are wrong: they must not matter
    rows = [(i, 1 - y if held(i, module.MODULUS, module.HELD_OUT) else y) for i, y in truth.items()]
    extra = [(9001, None), (9002, ""), (None, "x y"), (9003, "word " * 200_000), docs[0]]
    df = spark.createDataFrame([*docs, *extra], SCHEMA)
    labels = spark.createDataFrame([*rows, (1, None), (None, 1), (77777, 1)], f"doc_id long, {label} int")
    got = module.score(df, module.fit(df, labels)).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = [(r["score"] >= module.THRESHOLD) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and held(r["doc_id"], module.MODULUS, module.HELD_OUT)]
    assert np.mean(out) > 0.97
    empty = {r["doc_id"]: r["score"] for r in got}
    assert empty[9001] == empty[9002]


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels(spark, module, label):
    df = spark.createDataFrame([(1, "you idiot"), (2, "fine day")], SCHEMA)
    for rows in ([], [(1, 1)], [(1, 0), (2, 0)]):
        model = module.fit(df, spark.createDataFrame(rows, f"doc_id long, {label} int"))
        scores = {r["doc_id"]: r["score"] for r in module.score(df, model).collect()}
        assert all(0 <= s <= 1 for s in scores.values())
    assert module.score(df.limit(0), model).count() == 0
    assert module.score(df.selectExpr("doc_id", "text", "7 AS Score"), model).columns == ["doc_id", "text", "Score", "__score"]


def test_drop_toxic_keeps_columns(spark):
    docs, toxic, _ = corpus()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], f"{SCHEMA}, `__score` double")
    got = toxicity.drop_toxic(df, spark.createDataFrame(toxic, "doc_id long, toxic int"))
    assert got.columns == df.columns
    kept = {r["doc_id"] for r in got.collect()}
    right = [(i in kept) != bool(y) for i, y in toxic]
    assert np.mean(right) > 0.97


def test_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (5, 0)], "doc_id long, toxic int")
    got = labelled_sample(labels, "toxic", 4, 2, most=50).collect()
    assert len(got) == 50 and not any(held(r["doc_id"], 4, 2) for r in got)
    all_ = {r["doc_id"]: r["label"] for r in labelled_sample(labels, "toxic", 4, 2).collect()}
    assert len(all_) == sum(not held(i, 4, 2) for i in range(200)) and all_.get(5, 0) == 0
    flags = {r["doc_id"]: r["h"] for r in labels.select("doc_id", is_held_out("doc_id", 4, 2).alias("h")).collect()}
    assert all(f == held(i, 4, 2) for i, f in flags.items())


@pytest.mark.parametrize("estimate", [None, 10**9])
def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch, estimate):
    """With many labels, and where the estimate of their number is far off."""
    labels = spark.createDataFrame([(i % 3000, i % 2) for i in range(4000)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    ids = labels.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").collect()
    want = [r["doc_id"] for r in ids if not held(r["doc_id"], 4, 2)][:60]
    if estimate:
        monkeypatch.setattr(F, "approx_count_distinct", lambda c: F.lit(estimate))
    got = labelled_sample(labels, "toxic", 4, 2, most=60).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_isotonic():
    f = Isotonic.fit(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0, 1, 0, 1, 1, 1]))
    assert f.y.tolist() == sorted(f.y.tolist()) and f.y[0] == 0 and f.y[-1] == 1
    x = np.linspace(-10, 20, 300)
    assert (np.diff(f(x)) >= 0).all() and f(x).min() >= 0 and f(x).max() <= 1
    assert Isotonic.fit(np.array([2.0]), np.array([1]))(np.array([0.0, 9.0])).min() > 0.99


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    model = Trees.fit(x[:600], y[:600])
    assert ((model(x[600:]) > 0) == y[600:]).mean() > 0.93
    assert len(model(x[:0])) == 0


SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = frozenset([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS, CAPITALS, SPACES = frozenset(range(48, 58)), frozenset(range(65, 91)), frozenset([*range(9, 14), 32])
TEXTS = [
    "You IDIOT!! a1b s*x coool grumpf grumpfen", None, "", "Nice day. Nice day.", "   ", "ünïcode wörds", "aa", "a!!", "!? what", "??", "-grumpfling- you, GRUMPF's you're stupid",
    "one two three four five six seven you grumpf x x x x x x you", "line one.\nline two\r\nline one.\n\n#tag <b> 100% A AB ab", "AAA bbb'c-d e_f 12 3a " * 40, "\x7f\x01 x", "supercalifragilistic!!!", "moron" * 3 + " " + "loser, " * 9,
]


def count(data, some):
    return sum(b in some for b in data)


def naive_quality(text):
    """The statistics of one text, word by word."""
    data = (text or "").encode()
    chars = sum(not 128 <= b <= 191 for b in data)
    marks = frozenset(range(256)) - LETTERS - DIGITS - SPACES - frozenset(range(32))
    symbols = frozenset([*range(35, 39), 42, 43, *range(60, 63), 64, *range(91, 97), *range(123, 127)])
    words = SPACE.findall(data)
    n, stops, letters = len(words), count(data, b".!?"), count(data, LETTERS)
    size = [sum(not 128 <= b <= 191 for b in w) for w in words]
    per, mean = 1 / max(n, 1), sum(size) / max(n, 1)
    low = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    pairs = list(zip(low, low[1:], strict=False))
    lines = re.findall(rb"[^\n\r]+", data)
    line = 1 / max(len(lines), 1)
    capital = [count(w, CAPITALS) == count(w, LETTERS) > 1 for w in words]
    return [
        np.log1p(n), np.log1p(chars), mean, max(sum(x * x for x in size) * per - mean**2, 0) ** 0.5, sum(x > 14 for x in size) * per,
        letters / max(len(data), 1), count(data, CAPITALS) / max(letters, 1), count(data, DIGITS) / max(chars, 1), count(data, SPACES) / max(chars, 1),
        count(data, marks) / max(chars, 1), count(data, symbols) / max(chars, 1), sum(a == b and b in marks for a, b in zip(data, data[1:], strict=False)) / max(chars, 1), sum(not count(w, LETTERS) for w in words) * per, sum(capital) * per,
        sum(count(w, marks) >= 2 for w in words) * per, stops * per, np.log1p(stops), len(set(low)) * per, (len(pairs) - len(set(pairs))) * per,
        np.log1p(len(lines)), np.log1p(sum(map(len, lines)) * line), sum(x[-1] in b".!?" for x in lines) * line, len(set(lines)) * line, np.log1p(n / max(stops, 1)),
    ]


def naive_toxicity(text, words_, stems):
    """The features of one text; words_ and stems: what the lexicon knows."""
    data = (text or "").encode()
    marks = frozenset(range(33, 256)) - LETTERS - DIGITS
    tokens = SPACE.findall(data)
    bare = []
    for t in tokens:
        some = [k for k, b in enumerate(t) if b in LETTERS | DIGITS]
        bare.append(t[some[0] : some[-1] + 1] if some else t)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in bare]
    listed = [w.decode(errors="replace") in toxicity.INSULTS for w in low]
    word = [words_.get(w, 0.0) for w in low]
    stem = [stems.get(w[: toxicity.STEM], 0.0) if len(w) > toxicity.STEM else 0.0 for w in low]
    weight = [max(a, b, 3.0 * c) for a, b, c in zip(word, stem, listed, strict=True)]
    hit = [x >= 1.5 for x in weight]
    you = [k for k, w in enumerate(low) if w.decode(errors="replace") in toxicity.SECOND_PERSON]
    near = sum(h and any(abs(k - y) <= toxicity.NEAR for y in you) for k, h in enumerate(hit))
    n, hits, letters = len(tokens), sum(hit), count(data, LETTERS)
    per = 1 / max(n, 1)
    mixed = [(count(w, DIGITS) > 0 or count(w, marks) > count(w, b"'-")) and count(w, LETTERS) > 0 for w in bare]
    long = [any(w[k] == w[k + 1] == w[k + 2] and w[k] in LETTERS for k in range(len(w) - 2)) for w in low]
    return [
        sum(listed) * per, np.log1p(sum(listed)), sum(max(x, 0) for x in word) * per, sum(max(x, 0) for x in stem) * per,
        hits * per, np.log1p(hits), max([0.0, *weight]), sum(weight) / max(hits, 1),
        near * per, near / max(hits, 1), len(you) * per,
        count(data, CAPITALS) / max(letters, 1), sum(count(w, CAPITALS) == count(w, LETTERS) > 1 for w in bare) * per,
        count(data, marks) / max(len(data), 1), count(data, b"!?") * per, sum(mixed) * per, sum(long) * per, np.log1p(n),
    ]


def test_quality_statistics_against_brute_force():
    """In one batch, so that no text may see its neighbours."""
    got = quality.statistics(pa.array(TEXTS, pa.string()))
    for t, x in zip(TEXTS, got, strict=True):
        assert np.allclose(x, naive_quality(t)), (t, np.flatnonzero(~np.isclose(x, naive_quality(t))))


def test_toxicity_features_against_brute_force():
    words_, stems = {b"grumpf": 2.5, b"day": -1.0, b"x": 1.6, b"moron": 1.0}, {b"grump": 1.7, b"super": 0.4, b"stupi": -2.0}
    of = lambda keys: toxicity.textops.word_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*toxicity.textops.buffers(pa.array([k.decode() for k in keys], pa.large_string()))))
    keys = np.concatenate([of(words_), toxicity.textops.mix(of(stems) + np.uint64(1))])
    weights = np.repeat(np.array([*words_.values(), *stems.values()])[:, None], 5, axis=1)
    order = np.argsort(keys)
    got = toxicity.features(toxicity.read(pa.array(TEXTS, pa.string())), toxicity.Lexicon(keys[order], weights[order]))
    for t, x in zip(TEXTS, got, strict=True):
        want = naive_toxicity(t, words_, stems)
        assert np.allclose(x, want), (t, np.flatnonzero(~np.isclose(x, want)))


def test_ties_at_the_threshold(spark, monkeypatch):
    """A score that equals the threshold counts as 1, and a toxic one goes."""
    from ledgerloom.llm import queries

    df = spark.createDataFrame([(1, "a", 0.3), (2, "b", 0.29999)], "doc_id long, text string, score double")
    assert {r["doc_id"]: r["predicted"] for r in queries._judged(df, 4, 2, 0.3).collect()} == {1: 1, 2: 0}
    docs, labels = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    for share, kept in ((0.3, 0), (0.2999, 1)):
        monkeypatch.setattr(toxicity, "fit", lambda *a, share=share, **k: quality.Model(None, None, None, share))
        assert toxicity.drop_toxic(docs, labels).count() == kept


def test_a_labelled_id_with_many_rows_teaches_once(spark):
    from ledgerloom.llm.learning import sample_texts

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None), (3, "c")] * 50, SCHEMA)
    ids = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, label int, fold int")
    assert sorted(map(tuple, sample_texts(docs, ids, "doc_id", "text").collect()), key=repr) == [("a", 1, 0), (None, 0, 1)]


def test_features_stand_by_themselves():
    """A text's numbers do not depend on its neighbours in the batch."""
    texts = ["You IDIOT!! a1b s*x coool", None, "", "Nice day. Nice day.", "   ", "ünïcode wörds"]
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros((0, 5)))
    for f in (quality.statistics, lambda t: toxicity.features(toxicity.read(t), lexicon)):
        whole = f(pa.array(texts, pa.string()))
        assert np.isfinite(whole).all()
        for k, t in enumerate(texts):
            assert np.allclose(f(pa.array([t], pa.string()))[0], whole[k])
    x = toxicity.features(toxicity.read(pa.array(texts[:1])), lexicon)[0]
    assert x[0] > 0 and x[8] > 0 and x[11] > 0 and x[15] > 0 and x[16] > 0
