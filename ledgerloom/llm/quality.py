"""Quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text (lengths, shares of letters, capitals, marks and
digits, repetition, sentence and line shapes) are standardised and mapped to
``WAVES`` random cosines, whose inner products approximate a Gaussian kernel.
Ridge scores solve the normal equations, which the tasks sum over their rows
and the driver adds up: one matrix for each fold of a bounded sample of labelled
rows (``learning.SAMPLE``), whatever the input.  The calibration is fitted on
scores whose equations leave the fold out.  Statistics are computed once for
the sample and once for all texts, in one pass without a shuffle; only texts go
to the tasks, and only scores come back.

Defined cases: null and empty texts have zero statistics and get the score of
those; repeated rows get a row each; a labelled id with several texts teaches
the least of them; without labelled rows of both kinds every score is the share
of 1 among the labels there are (0.5 without any); a score equal to the
threshold counts as good; an empty table gives an empty table.  Labels, lang,
source and ids are not statistics.
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
from ledgerloom.llm.common import cut, free, mapped
from ledgerloom.llm.learning import FOLDS, Isotonic, labelled_sample, sample_texts

MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3
WAVES = 384
GAMMA = 0.35
RIDGE = 1.0
#: Partitions of the sample's statistics, so matrices that come to the driver, at most.
PARTS = 8
N_STATISTICS = 24

_LETTER = textops.class_table((65, 90), (97, 122), (128, 255))
_CAPITAL = textops.class_table((65, 90))
_DIGIT = textops.class_table((48, 57))
_SPACE = textops.class_table((9, 13), (32, 32))
_SYMBOL = textops.class_table((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126))  # no sentence marks
_MARK = ~(_LETTER | _DIGIT | _SPACE | textops.class_table((0, 31)))
_STOP = textops.class_table((33, 33), (46, 46), (63, 63))
_LEAD = ~textops.class_table((128, 191))  # the first byte of a character


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, N_STATISTICS)."""
    data, offsets = textops.buffers(texts)
    n = len(offsets) - 1
    at, to = offsets[:-1], offsets[1:]
    total = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    share = lambda c: c[to] - c[at]
    tables = {"letter": _LETTER, "capital": _CAPITAL, "digit": _DIGIT, "space": _SPACE, "symbol": _SYMBOL, "mark": _MARK, "stop": _STOP, "lead": _LEAD}
    count = {k: total(t[data]) for k, t in tables.items()}
    by = {k: share(c).astype(float) for k, c in count.items()}
    pair = np.zeros(len(data), bool)
    pair[1:] = (data[1:] == data[:-1]) & _MARK[data[1:]]
    pair[offsets[:-1][offsets[:-1] < len(data)]] = False  # not with the end of the text before
    doubled = share(total(pair)).astype(float)
    low = textops.lowered(data)
    starts, ends, first = textops.words(data, offsets, textops.NOT_SPACE)
    doc = textops.owners(first)
    h = textops.word_hashes(low, starts, ends)
    words = np.diff(first).astype(float)
    add = lambda x: np.bincount(doc, x, n)
    of = lambda k: count[k][ends] - count[k][starts]
    length = of("lead").astype(float)
    letters, marks = of("letter"), of("mark")
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n).astype(float)
    if len(h) > 1:  # bigrams met before in the text
        two = textops.mix(h[:-1] * np.uint64(3) + h[1:])
        inside = doc[1:] == doc[:-1]
        two, d2 = two[inside], doc[:-1][inside]
        o = np.lexsort((two, d2))
        again = np.zeros(len(two), bool)
        again[1:] = (two[o][1:] == two[o][:-1]) & (d2[o][1:] == d2[o][:-1])
        repeated = np.bincount(d2[o][again], minlength=n).astype(float)
    else:
        repeated = np.zeros(n)
    s, e, lines = textops.words(data, offsets, ~textops.class_table((10, 10), (13, 13)))
    line_doc = textops.owners(lines)
    n_lines = np.diff(lines).astype(float)
    line_add = lambda x: np.bincount(line_doc, x, n)
    size = (e - s).astype(float)
    ended = _STOP[data[e - 1]] if len(e) else np.zeros(0, bool)
    lh = textops.word_hashes(data, s, e)
    o = np.lexsort((lh, line_doc))
    line_new = np.ones(len(lh), bool)
    line_new[1:] = (lh[o][1:] != lh[o][:-1]) | (line_doc[o][1:] != line_doc[o][:-1])
    distinct_lines = np.bincount(line_doc[o][line_new], minlength=n).astype(float)
    chars, per, line = np.maximum(by["lead"], 1), 1 / np.maximum(words, 1), 1 / np.maximum(n_lines, 1)
    mean = add(length) * per
    lone = (letters == 0).astype(float)  # words without a letter
    capital_words = ((of("capital") > 0) & (of("capital") == letters) & (letters > 1)).astype(float)
    return np.stack([
        np.log1p(words), np.log1p(by["lead"]), mean, np.sqrt(np.maximum(add(length**2) * per - mean**2, 0)), add(length > 14) * per,
        by["letter"] / np.maximum(offsets[1:] - offsets[:-1], 1), by["capital"] / np.maximum(by["letter"], 1), by["digit"] / chars, by["space"] / chars,
        by["mark"] / chars, by["symbol"] / chars, doubled / chars, add(lone) * per, add(capital_words) * per,
        add(marks >= 2) * per, by["stop"] * per, np.log1p(by["stop"]), distinct * per, repeated * per,
        np.log1p(n_lines), np.log1p(line_add(size) * line), line_add(ended) * line, distinct_lines * line, np.log1p(words / np.maximum(by["stop"], 1)),
    ], axis=1)


@dataclass
class Waves:
    """x to cos(standardised x @ w + b), and a constant."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(5))
        w = rng.standard_normal((N_STATISTICS, WAVES)) * np.sqrt(2 * GAMMA / N_STATISTICS)
        b = rng.uniform(0, 2 * np.pi, WAVES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / WAVES), np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    waves: Waves | None
    weights: np.ndarray | None
    calibration: Isotonic | None
    share: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return self.calibration(self.waves(statistics(texts)) @ self.weights)


def _statistics_of(sample: DataFrame) -> DataFrame:
    """(label, fold, x0 ..) of the labelled sample."""
    names = [f"x{k}" for k in range(N_STATISTICS)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = textops.buffers(b.column(0))
            for i, j in textops.slices(offsets):
                x = statistics(b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), *map(pa.array, x.T)], ["label", "fold", *names])

    return mapped(sample, task, ", ".join(["label int", "fold int", *(f"{c} double" for c in names)]))


def _solve(g: np.ndarray) -> np.ndarray:
    """Ridge weights from the summed [features, label] products."""
    a, b = g[:-1, :-1].copy(), g[:-1, -1]
    a[np.diag_indices(len(a) - 1)] += RIDGE * max(g[-2, -2], 1) / 1e4 + 1e-9  # the constant is free
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model learnt from the labels outside the held-out remainder."""
    ids = labelled_sample(labels, label, MODULUS, HELD_OUT)
    rows = cut(_statistics_of(sample_texts(docs, ids, id, text)))
    names = [f"x{k}" for k in range(N_STATISTICS)]
    stats = rows.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names], F.avg("label"), F.min("label"), F.max("label")).first()
    if stats[-1] is None or stats[-1] == stats[-2]:
        return Model(None, None, None, 0.5 if stats[-3] is None else float(stats[-3]))
    waves = Waves(np.array(stats[:N_STATISTICS], float), np.maximum(np.array(stats[N_STATISTICS : 2 * N_STATISTICS], float), 1e-9))
    size = WAVES + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            y, fold = (b.column(k).to_numpy() for k in (0, 1))
            z = waves(np.stack([c.to_numpy() for c in b.columns[2:]], axis=1))
            z = np.concatenate([z, y[:, None]], axis=1)
            for k in np.unique(fold).tolist():
                part = z[fold == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fold", "sums"])

    g = np.zeros((FOLDS, size, size))
    # so many partitions at most, so that what comes to the driver is bounded; ordered within, for the same sums again
    dealt = rows.coalesce(PARTS).sortWithinPartitions(*names)
    for r in sorted(mapped(dealt, products, "fold int, sums binary").collect()):
        g[r["fold"]] += np.frombuffer(r["sums"]).reshape(size, size)
    folds = np.stack([_solve(g.sum(axis=0) - g[k]) for k in range(FOLDS)])

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = waves(np.stack([c.to_numpy() for c in b.columns[2:]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", z, folds[b.column(1).to_numpy()])), b.column(0)], ["score", "label"])

    got = mapped(rows, outside, "score double, label int").toArrow()
    calibration = Isotonic.fit(got.column("score").to_numpy(), got.column("label").to_numpy())
    return Model(waves, _solve(g.sum(axis=0)), calibration, float(stats[-3]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the quality of each whole text, 0 to 1, under a fresh name where docs has one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> pa.Array:
        _, offsets = textops.buffers(texts)
        return pa.array(np.concatenate([np.zeros(0), *(shared.value(texts.slice(i, j - i)) for i, j in textops.slices(offsets))]))

    return docs.withColumn(free(docs, name), by_cell(docs, text, work, T.DoubleType()))
