"""Small learners in numpy, and the bounded sample of labelled rows that they are fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import column, cut

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
FOLDS = 4


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, id: str = "doc_id", most: int = SAMPLE) -> DataFrame:
    """(doc_id, label, fold) of at most ``most`` documents; none with crc32(id) mod modulus = held_out.

    A document labelled more than once counts as 1 if half its labels are; null ids and labels teach nothing.

    Where there are many labels, an estimate of the number of their ids gives a
    bound that about twice as many hashes as asked stay under; so neither all
    labels are shuffled nor does the one task that orders them get more than
    those.  Should fewer be left than asked, all are ordered.
    """
    rows = labels.select(column(id).cast("long").alias("doc_id"), column(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held_out)
    order = F.xxhash64("doc_id")
    voted = lambda df: df.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    found, ids = voted(rows), rows.agg(F.approx_count_distinct("doc_id")).first()[0]
    if ids > 2 * most:
        under = cut(voted(rows.where(order < F.lit((2 * most << 64) // ids - (1 << 63)))))
        found = under if under.count() >= most else found
    return found.orderBy(order, "doc_id").limit(most).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int"))


def sample_texts(docs: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """(text, label, fold) of each of the sample's ids that docs has, once: of several texts of one id the least.

    The ids, at most ``SAMPLE``, are broadcast; texts are folded before they are shuffled, so an id may have any number of rows.
    """
    texts = docs.select(column(id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text")).select("text", "label", "fold")


def is_held_out(id: str, modulus: int, remainder: int):  # noqa: ANN201
    return F.coalesce(F.pmod(F.crc32(column(id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


@dataclass
class Isotonic:
    """A non-decreasing step fit, read with straight lines between its blocks' means.

    A thousandth of the raw score's own place is mixed in, so that equal steps keep the raw order.
    """

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        s, first = np.unique(score[order], return_index=True)
        weight = np.diff(np.append(first, len(order))).astype(float)
        sums = np.add.reduceat(label[order].astype(float), first)
        blocks: list[list[float]] = []  # sum, weight, lowest and highest score
        for v, w, t in zip(sums, weight, s, strict=True):
            blocks.append([v, w, t, t])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                v2, w2, _, hi = blocks.pop()
                blocks[-1][0] += v2
                blocks[-1][1] += w2
                blocks[-1][3] = hi
        x, y = [], []
        for v, w, lo, hi in blocks:
            x += [lo] if lo == hi else [lo, hi]
            y += [v / w] * (1 if lo == hi else 2)
        return cls(np.array(x), np.array(y))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        lo, hi = float(self.x[0]), float(self.x[-1])
        place = 1 / (1 + np.exp(np.clip(-4 * (score - (lo + hi) / 2) / max(hi - lo, 1e-9), -500, 500)))
        return np.clip(0.999 * np.interp(score, self.x, self.y) + 0.001 * place, 0.0, 1.0)


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, on binned features."""

    edges: list[np.ndarray]  # of the bins, a list for each feature
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right if the value is over it
    leaf: np.ndarray  # (trees, leaves)
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], axis=1)
        width = bins + 1
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p0 / (1 - p0)))
        score = np.full(n, base)
        inner = (1 << depth) - 1
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
        flat = binned + np.arange(d) * width
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                m = 1 << level
                place = (node[:, None] * (d * width) + flat).reshape(-1)
                gs = np.bincount(place, np.repeat(g, d), m * d * width).reshape(m, d, width)
                hs = np.bincount(place, np.repeat(h, d), m * d * width).reshape(m, d, width)
                gl, hl = np.cumsum(gs, axis=2), np.cumsum(hs, axis=2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                for k in range(m):
                    j, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                    at = m - 1 + k
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        feature[t, at], cut[t, at] = j, edges[j][b]
                at = m - 1 + node
                node = node * 2 + (x[np.arange(n), feature[t, at]] > cut[t, at])
            gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
            leaf[t] = rate * gs / (hs + ridge)
            score += leaf[t, node]
        return cls(edges, feature, cut, leaf, base)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        n, rows = len(x), np.arange(len(x))
        score = np.full(n, self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(n, np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return score
