"""Ranked lexical search with block-max pruning.

``build`` makes an index of a table's documents.  A block is a range of the
table: documents that stand one after the other in an input partition, at most
``DOCS`` of them or about ``ENTRIES`` terms.  It holds its terms, for each the
number of its documents with the term and the largest weight-free score that any
of them gives it (its maximum), and its forward part, each document's terms and
how often they occur.

``search`` ranks all documents for each item.  A block's bound for an item is
the sum of the item's term weights times the block's maxima, so no document of
the block scores more.  The ``SEEDS`` blocks with the highest bounds are scored
first; the k-th best score found is the item's threshold.  Then a task goes
through its blocks, of each batch the highest bounds first, and scores for each
block the items whose threshold is not above the block's bound, raising the
thresholds as it goes.  A block at just the threshold is scored, since equal
scores are ranked by id; so the result is that of scoring everything.

Plan: texts are read twice, for the totals and for the blocks, and neither they
nor blocks are ever shuffled; only each task's best are.  A task holds one batch
of blocks and k results an item.  Items are taken in chunks of at most ``CHUNK``
terms and ``ITEMS`` items (one longer item stands alone): a chunk's terms are the
only thing that is broadcast, and its document frequencies, its thresholds and
the numbers of its ``ITEMS * SEEDS`` first blocks the only things that come to
the driver.  Each chunk reads the index anew, the forward parts only twice.
Sums are exact: they stay below 2 ** 53, or are made of 64-bit integers.

Defined cases: null texts and texts without terms are in no block and never
found; a null id counts as the largest one and is returned as null; repeated
rows are documents each; an item's rows, if there are several, are one item with
the terms of all; an item without terms, or without a document that scores
above 0, has no rows; an empty table gives no rows.  Terms are told apart by 64-bit
hashes: with a billion different terms an item's term is confused with another
one with probability 1e-10.  Input columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.arrow import mapped
from ledgerloom.checkpoints import cut, folder, removed
from ledgerloom.llm import textops
from ledgerloom.llm.common import column

TOP = 10
#: Documents and (document, term) entries of a block.
DOCS, ENTRIES = 64, 1 << 16
SEEDS = 8
#: Terms and items of a chunk.
CHUNK, ITEMS = 1 << 18, 1024
#: Fixed values of the score: a document's share of the mean length in hundredths, and the scale of a term's weight and part.
FLAT, LONG, WEIGHT, SCALE, NEAR, FAR = 10, 90, 1000, 1_000_000_000, 1000, 8
#: Bytes of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
TERM = ~textops.class_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_NO_ID = np.iinfo(np.int64).max

_INDEX = "block long, terms binary, docs binary, parts binary, ids binary, lengths binary, starts binary, places binary, counts binary"
_FORWARD = ("ids", "lengths", "starts", "places", "counts")


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: first and last text, words of each, and the distinct (text, term hash, count) by text and hash."""
    data, offsets = textops.buffers(texts)
    for i, j in textops.slices(offsets):
        part = textops.lowered(data[offsets[i] : offsets[j]])
        starts, ends, first = textops.words(part, offsets[i : j + 1] - offsets[i], TERM)
        found, code = np.unique(textops.word_hashes(part, starts, ends), return_inverse=True)
        keys, counts = np.unique(textops.owners(first) * max(1, len(found)) + code, return_counts=True)
        owner, term = np.divmod(keys, max(1, len(found)))
        yield i, j, np.diff(first), owner, found[term], counts


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms."""
    docs = terms = 0
    for batch in batches:
        data, offsets = textops.buffers(batch.column(0))
        for i, j in textops.slices(offsets):
            *_, first = textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TERM)
            docs, terms = docs + int(np.count_nonzero(np.diff(first))), terms + int(first[-1])
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["n", "whole"])


def _least(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _blocks(n: int, whole: int, most_docs: int, most_entries: int):  # noqa: ANN202
    """Blocks of (id, text) rows; texts without terms are left out."""

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, lengths, terms, counts = zip(*held, strict=True)
        lengths, sizes, counts = np.array(lengths, np.int64), [len(t) for t in terms], np.concatenate(counts)
        found, places, docs = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
        best = np.zeros(len(found), np.int32)
        np.maximum.at(best, places, _parts(counts, np.repeat(lengths, sizes), n, whole).astype(np.int32))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cells = [found, _least(docs), best, np.array(ids, np.int64), lengths, starts, _least(places), _least(counts)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], [x.split()[0] for x in _INDEX.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, entries = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # id, length, terms, counts
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
            for i, j, lengths, owner, terms, counts in _terms(batch.column(1)):
                at = np.searchsorted(owner, np.arange(j - i + 1))
                for k in np.flatnonzero(lengths):
                    held.append((int(ids[i + k]), int(lengths[k]), terms[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]))
                    entries += at[k + 1] - at[k]
                    if len(held) == most_docs or entries >= most_entries:
                        yield block(number, held)
                        held, number, entries = [], number + 1, 0
        if held:
            yield block(number, held)

    return task


def _parts(counts: np.ndarray, lengths: np.ndarray, n: int, whole: int) -> np.ndarray:
    """What each entry adds to a score for each unit of its term's weight."""
    big = int(lengths.max(initial=0)) * n * LONG >= 1 << 62
    long = np.array([LONG * int(x) * n // whole for x in lengths], np.int64) if big else LONG * lengths * n // whole
    counts = counts.astype(np.int64)
    return SCALE * counts // (NEAR * counts + FAR * (FLAT + long))


def _numbers(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _narrow(cell: pa.Scalar, n: int) -> np.ndarray:
    """n whole numbers as ``_least`` wrote them."""
    return np.frombuffer(cell.as_buffer(), f"u{cell.as_buffer().size // max(1, n)}") if n else np.zeros(0, np.int64)


@dataclass
class Index:
    """An index below a folder: its blocks, the documents with a term and their terms."""

    folder: str
    n: int
    whole: int
    blocks: DataFrame


def index_folder(spark: SparkSession) -> str:
    return f"{folder(spark.sparkContext)}/lexical-{uuid.uuid4().hex}"


def build(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> Index:
    """The index of docs, written below ``path``.  id: a whole number."""
    spark = docs.sparkSession
    texts = docs.select(column(id).cast("long").alias("id"), column(text).alias("text"))
    totals = mapped(texts.select("text"), _totals, "n long, whole long").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).fillna(0)
    n, whole = totals.first()
    spark.createDataFrame([(n, whole)], "n long, whole long").write.parquet(f"{path}/totals")
    mapped(texts, _blocks(n, whole, DOCS, ENTRIES), _INDEX).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    n, whole = spark.read.parquet(f"{path}/totals").first()
    return Index(path, n, whole, spark.read.schema(_INDEX).parquet(f"{path}/blocks"))


@dataclass
class Chunk:
    """Some items: their terms as places in a sorted vocabulary, the items' entries one after the other."""

    names: list
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # score that a document needs to be among the best

    @property
    def exact(self) -> type:
        """Doubles where all sums are whole numbers that they hold."""
        most = np.bincount(self.item, self.weight, len(self.names)).max(initial=0) * SCALE / NEAR
        return np.float64 if most < 1 << 53 else np.int64

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms are in the vocabulary, their places there)."""
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == terms)
        return known, at[known]

    def bounds(self, terms: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The bound of a block for each item."""
        known, at = self.places(terms)
        best = np.zeros(len(self.vocabulary), np.int64)
        best[at] = parts[known]
        out = np.zeros(len(self.names), np.int64)
        np.add.at(out, self.item, self.weight * best[self.term])
        return out


def _chunks(items: DataFrame, id: str, text: str) -> Iterator[Chunk]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, owner, terms, _ in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + owner)), pa.array(terms.view(np.int64))], ["name", "term"])

    kind = items.select(column(id)).schema[0].dataType
    rows = items.select(column(id).alias("name"), column(text).alias("text"))
    rows = mapped(rows, task, T.StructType([T.StructField("name", kind), T.StructField("term", T.LongType())])).distinct().orderBy("name", "term")
    names: list = []
    item: list[int] = []
    term: list[int] = []

    def chunk() -> Chunk:
        vocabulary, at = np.unique(np.array(term, np.int64).view(np.uint64), return_inverse=True)
        return Chunk(names, vocabulary, np.array(item, np.int64), at)

    for r in rows.toLocalIterator():
        if not names or names[-1] != r["name"]:
            if len(names) == ITEMS or len(term) >= CHUNK:
                yield chunk()
                names, item, term = [], [], []
            names.append(r["name"])
        item.append(len(names) - 1)
        term.append(r["term"])
    if names:
        yield chunk()


def _weigh(index: Index, chunk: Chunk) -> None:
    """Gives the chunk's terms their weights, by the documents that hold them."""
    known = index.blocks.sparkSession.sparkContext.broadcast(chunk)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        docs = np.zeros(len(held.vocabulary), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms = _numbers(batch.column(0)[k], np.uint64)
                some, at = held.places(terms)
                docs[at] += _narrow(batch.column(1)[k], len(terms))[some]
        met = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(docs[met])], ["term", "docs"])

    docs = np.zeros(len(chunk.vocabulary), np.int64)
    for r in mapped(index.blocks.select("terms", "docs"), task, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        docs[r["term"]] = r["docs"]
    known.destroy()
    weights = [math.floor(WEIGHT * math.log((2 * index.n + 2) / (2 * int(d) + 1))) for d in docs]
    chunk.weight = np.array(weights, np.int64)[chunk.term]


def _seeds(index: Index, chunk: Broadcast, seeds: int) -> DataFrame:
    """(item, block, bound) of the blocks with the highest bounds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Chunk = chunk.value
        blocks, bounds = np.zeros((0, len(held.names)), np.int64), np.zeros((0, len(held.names)), np.int64)
        for batch in batches:
            new = np.array([held.bounds(_numbers(batch.column(1)[k], np.uint64), _numbers(batch.column(2)[k], np.int32)) for k in range(batch.num_rows)], np.int64).reshape(-1, len(held.names))
            number = np.repeat(batch.column(0).to_numpy()[:, None], len(held.names), 1)
            blocks, bounds = np.concatenate([blocks, number]), np.concatenate([bounds, new])
            best = np.argsort(-bounds, 0, kind="stable")[:seeds]
            blocks, bounds = np.take_along_axis(blocks, best, 0), np.take_along_axis(bounds, best, 0)
        some = np.nonzero(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(some[1]), pa.array(blocks[some]), pa.array(bounds[some])], ["item", "block", "bound"])

    found = mapped(index.blocks.select("block", "terms", "parts"), task, "item long, block long, bound long")
    return _first(found, "item", [F.desc("bound"), F.asc("block")], seeds)


def _scored(index: Index, blocks: DataFrame, chunk: Broadcast, top: int, scored: Accumulator | None) -> DataFrame:
    """(item, score, id): the best of each task over some blocks, of each batch the highest bounds first."""
    n, whole = index.n, index.whole

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Chunk = chunk.value
        order = np.argsort(held.item, kind="stable")
        begins = np.searchsorted(held.item[order], np.arange(len(held.names) + 1))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least, kind = held.least.copy(), held.exact
        for batch in batches:
            bounds = [held.bounds(_numbers(batch.column(0)[k], np.uint64), _numbers(batch.column(1)[k], np.int32)) for k in range(batch.num_rows)]
            for k in sorted(range(len(bounds)), key=lambda k: -bounds[k].max(initial=0)):
                items = np.flatnonzero(bounds[k] >= least)
                if not len(items):
                    continue
                if scored is not None:
                    scored.add(len(items))
                terms = _numbers(batch.column(0)[k], np.uint64)
                ids, lengths, starts = (_numbers(batch.column(c)[k], np.int64) for c in (2, 3, 4))
                places, counts = (_narrow(batch.column(c)[k], int(starts[-1])) for c in (5, 6))
                known, at = held.places(terms)  # which of the block's terms are asked for
                column_of = np.full(len(terms), -1)
                column_of[known] = np.arange(len(known))
                entry = np.flatnonzero(column_of[places] >= 0)
                owner = np.searchsorted(starts, entry, "right") - 1
                docs = np.zeros((len(ids), len(known)), kind)
                docs[owner, column_of[places[entry]]] = _parts(counts[entry], lengths[owner], n, whole)
                at_met = np.full(len(held.vocabulary), -1)
                at_met[at] = np.arange(len(known))
                entries = order[np.concatenate([np.arange(begins[i], begins[i + 1]) for i in items])]
                mine = np.repeat(np.arange(len(items)), begins[items + 1] - begins[items])
                rows = at_met[held.term[entries]]
                weights = np.zeros((len(known), len(items)), kind)
                weights[rows[rows >= 0], mine[rows >= 0]] = held.weight[entries[rows >= 0]]
                scores = (docs @ weights).astype(np.int64)
                for i in np.flatnonzero(scores.max(0, initial=0) >= least[items]):
                    item = int(items[i])
                    some = np.flatnonzero(scores[:, i] >= least[item])
                    old = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    values, names = np.concatenate([old[0], scores[some, i]]), np.concatenate([old[1], ids[some]])
                    first = np.lexsort((names, -values))[:top]
                    best[item] = values[first], names[first]
                    if len(first) == top:
                        least[item] = max(least[item], values[first[-1]])
        for item, (values, names) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), item)), pa.array(values), pa.array(names)], ["item", "score", "id"])

    return _first(mapped(blocks.select("terms", "parts", *_FORWARD), task, "item long, score long, id long"), "item", [F.desc("score"), F.asc("id")], top)


def _first(df: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def search(index: Index, items: DataFrame, id: str = "item_id", text: str = "text", top: int = TOP, scored: Accumulator | None = None) -> DataFrame:
    """(item, rank, doc, score): the ``top`` documents of each item with a score above 0; equal scores by ascending id.

    scored: is told how often a block was scored for an item.
    """
    spark = items.sparkSession
    kind = items.select(column(id)).schema[0].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item", kind)])).select("item", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score"))
    for chunk in _chunks(items, id, text):
        out = out.unionByName(_search(index, chunk, kind, top, scored))
    return out


def _search(index: Index, chunk: Chunk, kind: T.DataType, top: int, scored: Accumulator | None) -> DataFrame:
    spark = index.blocks.sparkSession
    _weigh(index, chunk)
    chunk.least = np.ones(len(chunk.names), np.int64)
    shared = spark.sparkContext.broadcast(chunk)
    first = [r["block"] for r in _seeds(index, shared, SEEDS).select("block").distinct().collect()]
    best = _scored(index, index.blocks.where(F.col("block").isin(first)), shared, top, scored)
    for r in best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect():
        chunk.least[r["item"]] = r["least"]
    raised = spark.sparkContext.broadcast(chunk)
    names = spark.createDataFrame(list(enumerate(chunk.names)), T.StructType([T.StructField("item", T.LongType()), T.StructField("name", kind)]))
    doc = F.when(F.col("id") != F.lit(int(_NO_ID)), F.col("id")).alias("doc")
    found = _scored(index, index.blocks, raised, top, scored).join(names, "item")
    done = cut(found.select(F.col("name").alias("item"), F.col("rank").cast("int").alias("rank"), doc, "score"))
    shared.destroy()
    raised.destroy()
    return done


def ranked(docs: DataFrame, items: DataFrame, id: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, doc, score) by an index that is made for this search and taken away."""
    spark = docs.sparkSession
    path = index_folder(spark)
    try:
        return search(build(docs, path, id, text), items, item, text, top)
    finally:
        removed(spark, path)


_PATTERN = "[^" + "".join(chr(92) + x for x in ("x00-", "x2F", "x3A-", "x40", "x5B-", "x60", "x7B-", "x7F")) + "]+"


def oracle(upper: str, lower: str) -> str:
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{_PATTERN}')"
    return f"""
WITH t AS (SELECT doc_id, unnest({words}) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS whole FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark WHERE text IS NOT NULL),
weights AS (SELECT term, floor({WEIGHT} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
parts AS (SELECT doc_id, term, ({SCALE} * tf) // ({NEAR} * tf + {FAR} * ({FLAT} + ({LONG} * n * docs) // whole)) AS part FROM tf JOIN n USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(w * part)::BIGINT AS score FROM q JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
