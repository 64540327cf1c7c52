"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of toxic words, by a small fixed list and
by a lexicon of words and word stems learnt from the labelled rows; how close
toxic words stand to a second person; capitals; punctuation; obfuscation
(letters mixed with digits or symbols, long repeats of a letter).

Learning: a bounded sample of labelled rows (``learning.SAMPLE``, never of the
held-out remainder) finds its texts by a broadcast of its ids.  The tasks count
in how many of its documents each word stands, by label and fold.  A word is
kept if it stands out: it is ``ODDS`` times as frequent in toxic documents, and
in ``SUPPORT`` of them or, where that is more, in one of ``SHARE``; so there are
at most SHARE times as many words as a toxic document of the sample has.  A
training document's features use the lexicon of the other folds, so the trees
learn what a lexicon is worth on texts it has not seen.  The calibration is
fitted on predictions of trees that have not seen the fold either.  Then all
texts are scored in one pass without a shuffle; only they go to the tasks, and
only scores come back.

Defined cases: null and empty texts have zero features and get the score of
those; repeated rows get a row each; a labelled id with several texts teaches
the least of them; without labelled rows of both kinds, the score follows the
fixed list's density alone; a score equal to the threshold is toxic; an empty
table gives an empty table.  Labels, lang, source and ids are not features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.arrow import by_cell
from ledgerloom.llm import textops
from ledgerloom.llm.common import cut, free, fresh, mapped
from ledgerloom.llm.learning import FOLDS, Isotonic, Trees, labelled_sample, sample_texts

MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bytes of text whose words are looked at together.
SLICE = 1 << 19
SUPPORT = 3
SHARE = 2000
ODDS = 3
STEM = 5
NEAR = 6
#: Insults of everyday English.
INSULTS = (
    "idiot", "idiots", "idiotic", "stupid", "moron", "morons", "moronic", "dumb", "fool", "foolish", "loser", "losers",
    "pathetic", "worthless", "trash", "garbage", "scum", "clown", "clowns", "disgusting", "ugly", "jerk", "creep",
    "imbecile", "cretin", "dimwit", "filth", "vermin", "hate", "disgrace", "coward", "liar", "useless", "freak",
)
#: Words that address someone, in English, German, French and Spanish.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros", "vuestro",
)
N_FEATURES = 18


def _hash_list(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = textops.buffers(pa.array(words, pa.large_string()))
    return np.unique(textops.word_hashes(data, offsets[:-1], offsets[1:]))


_LETTER = textops.class_table((65, 90), (97, 122), (128, 255))
_CAPITAL = textops.class_table((65, 90))
_DIGIT = textops.class_table((48, 57))
_MARK = ~(_LETTER | _DIGIT | textops.class_table((0, 32)))
_TRIM = _LETTER | _DIGIT


@dataclass
class Words:
    """The words of some texts: hashes of the bare word and of its stem, and sums over bytes."""

    bare: np.ndarray
    stem: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    sums: dict[str, np.ndarray]  # by text
    mixed: np.ndarray
    caps: np.ndarray
    long_repeat: np.ndarray


def read(texts: pa.Array) -> Words:
    data, offsets = textops.buffers(texts)
    low = textops.lowered(data)
    starts, ends, first = textops.words(data, offsets, textops.NOT_SPACE)
    total = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    letters, digits, marks, capitals = (total(t[data]) for t in (_LETTER, _DIGIT, _MARK, _CAPITAL))
    bangs, asks = total(data == 33), total(data == 63)
    twice = np.zeros(len(data), bool)
    if len(data) > 2:
        twice[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[data[2:]]
        for k in (0, 1):  # not together with the end of the text before
            first_bytes = offsets[:-1] + k
            twice[first_bytes[first_bytes < offsets[1:]]] = False
    repeats = total(twice)
    of = lambda c, a, b: c[b] - c[a]
    # a bare word begins at its first letter or digit and ends behind its last
    tail = total(_TRIM[data])
    n = len(starts)
    has = of(tail, starts, ends) > 0
    places = np.flatnonzero(_TRIM[data])
    a = np.where(has, places[np.minimum(tail[starts], max(len(places) - 1, 0))] if len(places) else starts, starts)
    b = np.where(has, (places[np.maximum(tail[ends] - 1, 0)] + 1) if len(places) else ends, ends)
    bare = textops.word_hashes(low, a, b) if n else np.zeros(0, np.uint64)
    stem = textops.word_hashes(low, a, np.minimum(b, a + STEM)) if n else np.zeros(0, np.uint64)
    stem = np.where(b - a > STEM, textops.mix(stem + np.uint64(1)), np.uint64(0))  # 0: too short to have one
    inner = (of(digits, a, b) > 0) | (of(marks, a, b) > of(total(data == 39) + total(data == 45), a, b))
    at, to = offsets[:-1], offsets[1:]
    sums = {"bytes": np.diff(offsets), "letters": of(letters, at, to), "marks": of(marks, at, to), "capitals": of(capitals, at, to), "bangs": of(bangs, at, to), "asks": of(asks, at, to), "digits": of(digits, at, to)}
    plain = of(letters, a, b)
    return Words(bare, stem, first, textops.owners(first), sums, inner & (plain > 0), (of(capitals, a, b) == plain) & (plain > 1), of(repeats, a, b) > 0)


@dataclass
class Lexicon:
    """Word and stem hashes with the fold-wise weights; fold FOLDS is the weight over all."""

    keys: np.ndarray
    weights: np.ndarray  # (keys, FOLDS + 1)

    def of(self, h: np.ndarray, fold: np.ndarray | int) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at, fold], 0.0)


_INSULTS, _SECOND = _hash_list(INSULTS), _hash_list(SECOND_PERSON)


def _in(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def features(w: Words, lexicon: Lexicon, fold: np.ndarray | None = None) -> np.ndarray:
    """(texts, N_FEATURES); fold: of each text, to leave what the lexicon knows from it out."""
    n = len(w.first) - 1
    by = FOLDS if fold is None else fold[w.doc]
    word, stem, listed = lexicon.of(w.bare, by), lexicon.of(w.stem, by), _in(w.bare, _INSULTS)
    weight = np.maximum(np.maximum(word, stem), listed * 3.0)
    hit = weight >= 1.5
    you = np.flatnonzero(_in(w.bare, _SECOND))
    near = np.zeros(len(w.bare), bool)
    if len(you):
        place = np.flatnonzero(hit)
        k = np.searchsorted(you, place)
        for other in (you[np.minimum(k, len(you) - 1)], you[np.maximum(k - 1, 0)]):
            near[place[(np.abs(other - place) <= NEAR) & (w.doc[other] == w.doc[place])]] = True
    add = lambda x: np.bincount(w.doc, x, n)
    words = np.diff(w.first).astype(float)
    per = 1 / np.maximum(words, 1)
    size = 1 / np.maximum(w.sums["bytes"], 1)
    most = np.zeros(n)
    np.maximum.at(most, w.doc, weight)
    hits = add(hit)
    return np.stack([
        add(listed) * per, np.log1p(add(listed)), add(np.maximum(word, 0)) * per, add(np.maximum(stem, 0)) * per,
        hits * per, np.log1p(hits), most, add(weight) / np.maximum(hits, 1),
        add(near) * per, add(near) / np.maximum(hits, 1), add(_in(w.bare, _SECOND)) * per,
        w.sums["capitals"] / np.maximum(w.sums["letters"], 1), add(w.caps) * per,
        w.sums["marks"] * size, (w.sums["bangs"] + w.sums["asks"]) * per,
        add(w.mixed) * per, add(w.long_repeat) * per, np.log1p(words),
    ], axis=1)


def _lexicon(sample: DataFrame) -> Lexicon:
    """The words and stems that stand out in the labelled sample (text, label, fold)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = textops.buffers(b.column(0))
            group = b.column(1).to_numpy().astype(np.int64) * FOLDS + b.column(2).to_numpy()
            for i, j in textops.slices(offsets, SLICE):
                w = read(b.column(0).slice(i, j - i))
                h = np.concatenate([w.bare, w.stem])
                doc = np.concatenate([w.doc, w.doc])[h != 0]
                h = h[h != 0]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, g = h[new], group[i:j][doc[new]]
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(g[start]), pa.array(np.diff(np.append(start, len(h))))], ["h", "g", "n"])

    kinds = range(2 * FOLDS)
    counts = mapped(sample, task, "h long, g long, n long").groupBy("h").agg(*[F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in kinds])
    toxic, clean = sum(F.col(f"n{k}") for k in range(FOLDS, 2 * FOLDS)), sum(F.col(f"n{k}") for k in range(FOLDS))
    sizes = sample.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    docs = np.zeros((2, FOLDS))
    for r in sizes:
        docs[r["label"], r["fold"]] = r["n"]
    share = docs[1].sum() / max(docs[0].sum(), 1)
    support = max(SUPPORT, docs[1].sum() / SHARE)
    got = counts.where((toxic >= support) & (toxic >= ODDS * share * clean)).toArrow()
    h = got.column("h").to_numpy().view(np.uint64)
    n = np.stack([got.column(f"n{k}").to_numpy() for k in kinds]).reshape(2, FOLDS, -1).astype(float)
    order = np.argsort(h)
    h, n = h[order], n[:, :, order]
    weights = []
    for k in range(FOLDS + 1):
        use = [f for f in range(FOLDS) if f != k]
        t, c = n[1, use].sum(axis=0), n[0, use].sum(axis=0)
        odds = np.log((t + 0.5) / (docs[1, use].sum() + 1)) - np.log((c + 0.5) / (docs[0, use].sum() + 1))
        weights.append(np.where(t >= SUPPORT - (k < FOLDS), odds, 0.0))
    return Lexicon(h, np.stack(weights, axis=1) if len(h) else np.zeros((0, FOLDS + 1)))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = features(read(texts), self.lexicon)
        if self.trees is None:
            return 1 - np.exp(-50 * x[:, 0])
        return self.calibration(self.trees(x))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model learnt from the labels outside the held-out remainder."""
    ids = labelled_sample(labels, label, MODULUS, HELD_OUT)
    sample = cut(sample_texts(docs, ids, id, text))
    lexicon = _lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = textops.buffers(b.column(0))
            fold = b.column(2).to_numpy()
            for i, j in textops.slices(offsets, SLICE):
                x = features(read(b.column(0).slice(i, j - i)), shared.value, fold[i:j])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), *map(pa.array, x.T)], ["label", "fold", *names])

    names = [f"x{k}" for k in range(N_FEATURES)]
    got = mapped(sample, task, ", ".join(["label int", "fold int", *(f"{c} double" for c in names)])).toArrow()
    y, fold = (got.column(c).to_numpy().astype(int) for c in ("label", "fold"))
    x = np.stack([got.column(c).to_numpy() for c in names], axis=1) if len(got) else np.zeros((0, N_FEATURES))
    order = np.lexsort((*x.T, y, fold))  # the same model whatever order the rows came in
    x, y, fold = x[order], y[order], fold[order]
    if len(np.unique(y)) < 2:
        return Model(lexicon, None, None)
    outside = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if (~rest).any():
            outside[~rest] = Trees.fit(x[rest], y[rest])(x[~rest]) if len(np.unique(y[rest])) == 2 else 0.0
    return Model(lexicon, Trees.fit(x, y), Isotonic.fit(outside, y))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1, under a fresh name where docs has one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> pa.Array:
        _, offsets = textops.buffers(texts)
        return pa.array(np.concatenate([np.zeros(0), *(shared.value(texts.slice(i, j - i)) for i, j in textops.slices(offsets, SLICE))]))

    return docs.withColumn(free(docs, name), by_cell(docs, text, work, T.DoubleType()))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    (name,) = fresh(docs, "score")
    return score(docs, fit(docs, labels, text=text, **options), text, name).where(F.col(name) < threshold).drop(name)
