"""Benchmark decontamination by training suffix arrays.

A task takes its documents in shards of a few megabytes and builds the suffix
array of each shard's words.  Every suffix of the benchmark items is
binary-searched in it, one word deeper at a time, which gives the range of
training positions that share its first words: the longest verbatim match and
all its locations.  A window (``window`` item words in a row, or a whole
shorter item) occurs where the range at its depth is not empty.

Only words of the benchmark's vocabulary can be part of a match, so a shard's
array holds the suffixes within runs of such words that are at least as long as
the shortest window; this loses nothing.  Only texts go to the tasks and only
findings come back; nothing is shuffled.  A benchmark of at most ``BLOCK_BYTES``
of text goes to the tasks as a broadcast.  A larger one is written to the
cluster's checkpoint folder in blocks of that size; the driver and the tasks
hold one at a time, and a task joins what they show in the same text.  Every
shard has to be searched for every block, so the work grows with their product.

Defined cases: null texts and texts without words have no words and are clean;
an item without words is ignored; items with equal texts count each; repeated
rows (document or item) count each, an item_id once, a null item_id as an empty one;
an empty benchmark leaves all documents clean.  Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.arrow import by_cell
from ledgerloom.checkpoints import folder
from ledgerloom.llm import textops
from ledgerloom.llm.common import column, free, fresh

WINDOW = 10
#: Text of the benchmark in one broadcast, at most (one item longer than this stands alone).
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])


@dataclass
class Tests:
    """A block of the benchmark: the items' words as ranks in a sorted vocabulary, and the windows."""

    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray  # ranks from 1, items one after the other, 0 behind each
    starts: np.ndarray  # suffix starts in words
    depth: np.ndarray  # words from each start to its item's end
    need: np.ndarray  # words of the window that starts there, 0: none starts there
    item: np.ndarray  # number of the item
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.need[self.need > 0].min()) if (self.need > 0).any() else 0


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textops.buffers(texts)
    data = textops.lowered(data)
    starts, ends, first = textops.words(data, offsets, textops.ALNUM)
    return textops.word_hashes(data, starts, ends), first


def tests(ids: list, texts: list, window: int = WINDOW) -> Tests:
    """The items' words, ready to be searched."""
    h, first = _hashes(pa.array(texts, pa.large_string()))
    vocabulary = np.unique(h)
    rank = np.searchsorted(vocabulary, h).astype(np.int32) + 1
    n = np.diff(first)
    place = np.arange(len(rank)) + textops.owners(first)  # a 0 behind each item
    words = np.zeros(len(rank) + len(n), np.int32)
    words[place] = rank
    item = textops.owners(first)
    depth = np.repeat(first[1:], n) - np.arange(len(rank))
    need = np.where(depth >= window, window, 0)
    whole = (n < window) & (n > 0)
    need[first[:-1][whole]] = n[whole]
    return Tests(vocabulary, words, place, depth, need, item, [x or "" for x in ids])


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in the order of the first ``depth`` words from each; words ends in a 0, which sorts first and ends a run.

    Prefix doubling: ranks by 1, 2, 4 .. words, until no two are alike or the depth is reached.
    """
    rank = words.astype(np.int64)
    order, k, n = starts, 1, len(words)
    at = np.arange(n)
    while True:
        step = np.where(rank > 0, rank[np.minimum(at + k // 2, n - 1)], 0) if k > 1 else np.zeros(n, np.int64)
        key = rank * (int(rank.max(initial=0)) + 1) + step if k > 1 else rank
        values, rank = np.unique(key, return_inverse=True)
        if values[0] != 0:
            rank = rank + 1  # 0 stays with the ends of runs
        order = starts[np.argsort(rank[starts], kind="stable")]
        if k >= depth or len(values) >= len(starts) + 1:
            return order
        k *= 2


def search(words: np.ndarray, array: np.ndarray, t: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix the array's range that shares its window (empty where none does), and the longest match in words."""
    lo, hi = np.zeros(len(t.starts), np.int64), np.full(len(t.starts), len(array), np.int64)
    longest = np.zeros(len(t.starts), np.int64)
    at_lo, at_hi = lo.copy(), lo.copy()
    alive, d, last = np.flatnonzero(hi > lo), 0, len(words) - 1
    while len(alive):
        alive = alive[t.depth[alive] > d]
        want = t.words[t.starts[alive] + d]
        a, b = lo[alive], hi[alive]
        for upper in (False, True):  # bisect for the first word not under want, then the first over it
            x, y = a.copy(), b.copy()
            while (open_ := x < y).any():
                mid = (x + y) // 2
                got = words[np.minimum(array[np.minimum(mid, len(array) - 1)] + d, last)]
                right = open_ & ((got <= want) if upper else (got < want))
                x = np.where(right, mid + 1, x)
                y = np.where(open_ & ~right, mid, y)
            if upper:
                hi[alive] = x
            else:
                lo[alive] = x
        alive = alive[hi[alive] > lo[alive]]
        d += 1
        longest[alive] = d
        here = alive[t.need[alive] == d]
        at_lo[here], at_hi[here] = lo[here], hi[here]
    return at_lo, at_hi, longest


@dataclass
class Found:
    """What one block of the benchmark shows in a shard: hit words, and for each text the items and the longest match."""

    hit: np.ndarray
    items: dict[int, set]
    longest: dict[int, tuple]  # (words, place, item)


def _shard(h: np.ndarray, first: np.ndarray, t: Tests, prefilter: np.ndarray) -> Found:
    """The findings among the word hashes of one shard's texts."""
    out = Found(np.zeros(len(h), bool), {}, {})
    if not len(h) or not t.shortest:
        return out
    maybe = np.flatnonzero(prefilter[(h >> np.uint64(44)).astype(np.int64)])
    rank = np.searchsorted(t.vocabulary, h[maybe])
    known = t.vocabulary[np.minimum(rank, len(t.vocabulary) - 1)] == h[maybe]
    maybe, rank = maybe[known], rank[known].astype(np.int32) + 1
    doc = np.searchsorted(first, maybe, "right") - 1
    new = np.ones(len(maybe), bool)
    new[1:] = (maybe[1:] != maybe[:-1] + 1) | (doc[1:] != doc[:-1])
    run = np.cumsum(new) - 1
    long = np.bincount(run)[run] >= t.shortest if len(run) else new
    maybe, rank, doc, run = maybe[long], rank[long], doc[long], run[long]
    if not len(maybe):
        return out
    place = np.arange(len(maybe)) + np.unique(run, return_inverse=True)[1]  # a 0 behind each run
    words = np.zeros(place[-1] + 2, np.int32)
    words[place] = rank
    where = np.zeros(len(words), np.int64)  # back to the shard's words
    where[place] = maybe
    owner = np.zeros(len(words), np.int64)
    owner[place] = doc
    array = suffix_array(words, place, int(t.depth.max()))
    lo, hi, _ = search(words, array, t)
    for some in _runs(np.flatnonzero(hi > lo), hi - lo):
        many = hi[some] - lo[some]
        which = np.repeat(some, many)
        spot = array[np.repeat(lo[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        _locate(out, t, words, where, owner, first, which, spot)
    return out


def _runs(found: np.ndarray, many: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """The test suffixes in runs of about ``most`` locations in all."""
    if len(found):
        part = np.cumsum(many[found]) // most
        yield from np.split(found, np.flatnonzero(np.diff(part)) + 1)


def _locate(out: Found, t: Tests, words: np.ndarray, where: np.ndarray, owner: np.ndarray, first: np.ndarray, which: np.ndarray, spot: np.ndarray) -> None:
    """Adds what test suffixes ``which`` show at the places ``spot``."""
    need = t.need[which].astype(np.int64)
    cover = np.zeros(len(out.hit) + 1, np.int64)
    np.add.at(cover, where[spot], 1)
    np.add.at(cover, where[spot] + need, -1)
    out.hit |= np.cumsum(cover[:-1]) > 0
    docs = owner[spot]
    length, more = need.copy(), np.arange(len(which))  # of each match from its place on
    while len(more):
        a, b = t.starts[which[more]] + length[more], spot[more] + length[more]
        same = (length[more] < t.depth[which[more]]) & (words[np.minimum(b, len(words) - 1)] == t.words[np.minimum(a, len(t.words) - 1)])
        more = more[same]
        length[more] += 1
    best = np.lexsort((t.item[which], where[spot], -length, docs))
    lead = best[np.concatenate([[True], docs[best][1:] != docs[best][:-1]])]
    for i in lead.tolist():
        d, x = int(docs[i]), (int(length[i]), -int(where[spot[i]] - first[docs[i]]), t.names[t.item[which[i]]])
        out.longest[d] = max(out.longest.get(d, (0, 0, "")), x)
    for pair in np.unique(docs * len(t.names) + t.item[which]).tolist():
        d, item = divmod(pair, len(t.names))
        out.items.setdefault(d, set()).add(t.names[item])


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of at most BLOCK_BYTES; they come to the driver block by block."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(column(text).isNotNull()).select(column(item_id).cast("string").alias("i"), column(text).alias("t"))
    for row in rows.toLocalIterator():
        n = len(row.t.encode())
        if ids and size + n > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    yield ids, texts


def _shared(context: SparkContext, blocks: Iterator[Tests]) -> Callable[[], Iterator[Tests]]:
    """A function for the tasks that gives the blocks, one at a time."""
    from pyarrow.fs import FileSystem

    first = next(blocks)
    if (second := next(blocks, None)) is None:
        whole = context.broadcast(first)
        return lambda: iter([whole.value])
    target, names = f"{folder(context)}/benchmark-{uuid.uuid4().hex}", []
    system, path = FileSystem.from_uri(target)
    system.create_dir(path, recursive=True)
    for t in chain([first, second], blocks):
        names.append(f"{path}/{len(names):06d}")
        with system.open_output_stream(names[-1]) as out:
            out.write(pickle.dumps(t))
        first = second = None

    def read() -> Iterator[Tests]:
        files, _ = FileSystem.from_uri(target)
        for name in names:
            with files.open_input_stream(name) as source:
                yield pickle.loads(source.read())

    return read


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns of ``FOUND`` added, under names that docs does not have (given too)."""
    new = [free(docs, f.name) for f in FOUND]
    (key,) = fresh(docs, "found")
    found = docs.withColumn(key, _found(docs, benchmark, text, item_id, item_text, window))
    return found.select(*[column(c) for c in docs.columns], *[column(key).getField(f.name).alias(n) for f, n in zip(FOUND, new, strict=True)]), new


def _found(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int):  # noqa: ANN202
    blocks, size = (tests(i, t, window) for i, t in _blocks(benchmark, item_id, item_text)), SHARD_BYTES
    read = _shared(docs.sparkSession.sparkContext, blocks)

    def work(texts: pa.Array) -> pa.Array:
        _, offsets = textops.buffers(texts)
        shards = [_hashes(texts.slice(i, j - i)) for i, j in textops.slices(offsets, size)]
        got: list[list[Found]] = [[] for _ in shards]
        for t in read():
            prefilter = np.zeros(1 << 20, bool)
            prefilter[(t.vocabulary >> np.uint64(44)).astype(np.int64)] = True
            for found, (h, first) in zip(got, shards, strict=True):
                found.append(_shard(h, first, t, prefilter))
        parts = [pa.StructArray.from_arrays(_joined(first, found), names=[f.name for f in FOUND]) for (_, first), found in zip(shards, got, strict=True)]
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(_joined(np.zeros(1, np.int64), []), names=[f.name for f in FOUND])

    return by_cell(docs, text, work, FOUND)


def _joined(first: np.ndarray, got: list[Found]) -> list[pa.Array]:
    """The findings of all blocks for the same texts: hit words and items are united, the longest match is kept."""
    n = len(first) - 1
    hits = np.concatenate([[0], np.cumsum(np.logical_or.reduce([g.hit for g in got]))]) if got else np.zeros(1, np.int64)
    n_hit = hits[first[1:]] - hits[first[:-1]]
    items = [sorted(set().union(*(g.items.get(k, ()) for g in got))) if n_hit[k] else [] for k in range(n)]
    best = [max((g.longest[k] for g in got if k in g.longest), default=None) if n_hit[k] else None for k in range(n)]
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array(n_hit > 0, pa.bool_()),
        pa.array([x[0] if x else 0 for x in best], pa.int64()),
        pa.array([-x[1] if x else None for x in best], pa.int64()),
        pa.array([x[2] if x else None for x in best], pa.string()),
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return docs.where(~_found(docs, benchmark, text, item_id, item_text, window).getField("contaminated"))
