"""MinHash near-duplicates with odd sketches.

Signatures.  A document's set is its distinct word shingles (hashed to 64
bits).  ``BANDS * ROWS`` MinHash samples give ``BANDS`` band keys; two sets of
similarity 0.8 share none of them with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
The samples are folded into an odd sketch: each flips one bit of ``64 *
LANES``.  The population count of two sketches' XOR then estimates their
similarity; pairs estimated far under the threshold (``far``) are not
compared in full.

Linking, without all pairs of a group:
1. Equal sets form a class, represented by its smallest document.
2. Each member of a band bucket is paired with the bucket's smallest member
   only; pairs that pass the sketch are confirmed on full sets.
3. A bucket whose members are by now one component has nothing left to show.
   In the others, members of different components are compared by sketch in
   blocks of at most ``BLOCK`` by ``BLOCK``, each pair only in the first band
   that it shares.  What leaves a block are not pairs but the members that have
   a near one in another component; their texts then come to the same block,
   where all of them in different components are compared on full sets, and
   only links that join two components leave it.
So no link between different components is lost, whatever a bucket's size.

Growth.  Steps 1 and 2 make a row for each member of a bucket.  In step 3 a
bucket that is left with several components and is larger than ``BLOCK`` gives
its members once to each of its parts, so n members make n * n / BLOCK rows and
n * n / 2 comparisons of 64 bytes: that many pairs may be links, and no bound
on them is known.  A group of copies is one component by then and takes no part.

Hot keys.  Classes and buckets are counted with map-side sums and cut, and rows
join those tables alone, with nothing else in the stage that needs a key's rows
together: so Spark can split a key that holds a third of all rows over tasks.

Defined cases: null and empty texts, and texts without words, have no shingles
and are linked with nothing; a text with fewer words than a shingle is one
shingle; repeated rows are members of one class; rows of the same id but other
texts are one document to the links, known by one of the texts; a null doc_id is
linked with nothing, has a null component_id and is kept; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import textops
from ledgerloom.llm.common import column, cut, fresh, mapped, total
from ledgerloom.operators.components import components

SHINGLE = 5
SIMILARITY = 80
BANDS, ROWS = 32, 4
LANES = 8
BLOCK = 2048
#: Ids of texts to be fetched that go out as a broadcast, at most (8 bytes each).
BROADCAST_IDS = 500_000
_CHUNK = 1 << 15

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()),
    T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType(), False)),
    *[T.StructField(f"s{k}", T.LongType()) for k in range(LANES)],
])


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other; and the n + 1 offsets."""
    data, offsets = textops.buffers(texts)
    data = textops.lowered(data)
    starts, ends, first = textops.words(data, offsets, textops.NOT_SPACE)
    h = textops.word_hashes(data, starts, ends)
    n = np.diff(first)
    rows = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(rows)])
    doc = textops.owners(at)
    start = first[doc] + np.arange(at[-1]) - at[doc]
    out, last = np.zeros(at[-1], np.uint64), first[doc + 1]
    for k in range(size):  # a short text's only shingle has fewer words
        there = start + k < last
        step = textops.mix((out * np.uint64(0x9E3779B97F4A7C15)) + h[np.minimum(start + k, max(len(h) - 1, 0))] + np.uint64(k + 1)) if len(h) else out
        out = np.where(there, step, out)
    for i in range(len(n)):
        out[at[i] : at[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))]).astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash samples of each set (a row a sample); empty sets get the largest value."""
    n = len(at) - 1
    out = np.full((BANDS * ROWS, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(np.diff(at) > 0)
    i = 0
    while i < len(full):  # runs of whole sets, or parts of a long one
        j = max(i + 1, int(np.searchsorted(at[full + 1], at[full[i]] + _CHUNK, "right")))
        lo, hi = int(at[full[i]]), int(at[full[j - 1] + 1])
        for a in range(lo, hi, _CHUNK) if j == i + 1 else (lo,):
            x = sets[a : min(hi, a + _CHUNK) if j == i + 1 else hi]
            cuts = np.zeros(1, np.int64) if j == i + 1 else at[full[i:j]] - lo
            tmp = np.empty(len(x), np.uint64)
            for k in range(BANDS * ROWS):
                np.multiply(x, _MULTIPLY[k], out=tmp)
                np.add(tmp, _ADD[k], out=tmp)
                got = np.minimum.reduceat(tmp, cuts)
                out[k, full[i:j]] = np.minimum(out[k, full[i:j]], got)
        i = j
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches, (documents, LANES): bit hash(k, sample) flips for each of the k samples."""
    k, n = samples.shape
    bits = textops.mix(samples + np.arange(k, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - 9)
    assert LANES == 8  # 9 bits
    flip = np.zeros((n, 512), np.uint8)
    rows = np.arange(n)
    for x in bits.astype(np.int64):
        flip[rows, x] ^= 1
    return np.packbits(flip, axis=1, bitorder="little").view("<u8")


def far(similarity: int = SIMILARITY, deviations: float = 5.0) -> int:
    """The XOR population count that a pair of at least this similarity exceeds about once in three million times.

    Of K samples d, K * (1 - s) on average, differ and flip two bits each; the
    expected count is n / 2 * (1 - (1 - 2 / n) ** (2 * d)).  Its spread comes
    from d, which is binomial, and from the bits that fall together.
    """
    k, n = BANDS * ROWS, 64 * LANES
    p = 1 - similarity / 100
    d = k * p
    keep = (1 - 2 / n) ** (2 * d)
    spread = (2 * keep) ** 2 * d * (1 - p) + n / 4 * (1 - keep**2)
    return int(n / 2 * (1 - keep) + deviations * spread**0.5)


def features(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """FEATURES of each document; bands is empty where there are no shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = textops.buffers(b.column(1))
            for i, j in textops.slices(offsets):
                sets, at = shingles(b.column(1).slice(i, j - i), shingle)
                n = np.diff(at)
                mixed = [textops.mix(sets + np.uint64(c)) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(m)]) for m in mixed]
                keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                samples = signatures(sets, at)
                band = np.zeros((BANDS, j - i), np.uint64) + (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[:, None]
                for r in range(ROWS):
                    band = textops.mix(band * np.uint64(0x9E3779B97F4A7C15) + samples[r::ROWS])
                full = n > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(np.ascontiguousarray(band.T[full]).reshape(-1).view(np.int64)))
                sketch = np.ascontiguousarray(sketches(samples).T).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *map(pa.array, keys), bands, *map(pa.array, sketch)], [f.name for f in FEATURES])

    return mapped(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), task, FEATURES)


def _apart(x: str, y: str) -> Column:
    """The population count of the XOR of two sketches."""
    return total([F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(LANES)])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (a, b) that are as similar as asked on their full sets."""
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            size = textops.buffers(batch.column(2))[1] + textops.buffers(batch.column(3))[1]
            for i, j in textops.slices(size):
                sides = []
                for k in (0, 1):
                    some, again = np.unique(ids[k][i:j], return_index=True)[1], np.unique(ids[k][i:j], return_inverse=True)[1]
                    sets, at = shingles(batch.column(2 + k).slice(i, j - i).take(pa.array(some)), shingle)
                    sides.append((sets, at, again))
                keep = np.zeros(j - i, bool)
                for r in range(j - i):
                    p, q = (s[at[g[r]] : at[g[r] + 1]] for s, at, g in sides)
                    both_ = len(np.intersect1d(p, q, assume_unique=True))
                    keep[r] = len(p) > 0 and 100 * both_ >= similarity * (len(p) + len(q) - both_)
                yield pa.RecordBatch.from_arrays([pa.array(x[i:j][keep]) for x in ids], ["a", "b"])

    return mapped(both, task, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (.., rep) with the component of each, rep itself where it is on no edge."""
    named = labels.select(F.col("node").alias("rep"), "component")
    return members.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _sides(part: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(part == p), np.flatnonzero(part == q)


def _blocks(members: DataFrame) -> DataFrame:
    """members (key, size, rep, ..) dealt into blocks: part of its bucket, and p <= q of the pair of parts.

    A part has about BLOCK members and BLOCK * 256 shingles at most (size is in parts); a bucket of k parts is dealt into each pair of them.
    """
    dealt = members.withColumn("parts", F.ceil("size").cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("size", "parts", "other")


def _active(members: DataFrame, limit: int, similarity: int) -> DataFrame:
    """(key, p, q, part, rep, component) of the members with a near one of another component in the block.

    members: key, size, hub, rep, component, n_shingles, bands, s0 ..  Pairs with the hub are known already.
    """

    def task(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, comp, part, hub, n = (group.column(c).to_numpy() for c in ("rep", "component", "part", "hub", "n_shingles"))
        sketch = np.stack([group.column(f"s{k}").to_numpy() for k in range(LANES)], axis=1).view(np.uint64)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = int(np.argmax(bands[0] == key[0].as_py()))
        left, right = _sides(part, key[1].as_py(), key[2].as_py())
        active = np.zeros(len(rep), bool)
        for i in left:
            near = right[(comp[right] != comp[i]) & (rep[right] != hub[0])]
            if rep[i] == hub[0]:
                continue
            near = near[100 * np.minimum(n[near], n[i]) >= similarity * np.maximum(n[near], n[i])]
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= limit]
            if len(near):
                near = near[np.argmax(bands[near] == bands[i], axis=1) == band]
                active[near] = True
                active[i] |= len(near) > 0
        rows = np.flatnonzero(active)
        return group.select(["key", "p", "q", "part", "rep", "component"]).take(pa.array(rows))

    return _blocks(members).groupBy("key", "p", "q").applyInArrow(task, "key long, p int, q int, part int, rep long, component long")


def _block_links(active: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Links (a, b) between members of different components, enough to join all that are linked within a block."""

    def task(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, comp, part = (group.column(c).to_numpy() for c in ("rep", "component", "part"))
        sets, at = shingles(group.column("text").combine_chunks(), shingle)
        if len(sets) == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        dense = np.unique(sets, return_inverse=True)[1]
        size, mark = np.diff(at), np.zeros(dense.max() + 2, np.int64)
        total_ = np.zeros(len(dense) + 1, np.int64)
        label = np.unique(comp, return_inverse=True)[1]
        left, right = _sides(part, key[1].as_py(), key[2].as_py())
        a, b = [], []
        for i in left:
            if not (label[right] != label[i]).any():
                continue
            mine = dense[at[i] : at[i + 1]]
            mark[mine] = 1
            np.cumsum(mark[dense], out=total_[1:])
            mark[mine] = 0
            both = total_[at[1:]] - total_[at[:-1]]
            ok = right[100 * both[right] >= similarity * (size[i] + size[right] - both[right])]
            for j in ok[size[ok] > 0].tolist():
                if label[j] != label[i]:
                    a.append(max(rep[i], rep[j]))
                    b.append(min(rep[i], rep[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = active.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("key", "p", "q", "part", "rep", "component", "text")
    return rows.groupBy("key", "p", "q").applyInArrow(task, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """One text of each of the ids (doc_id), of which there are ``most`` at most: by a broadcast where that allows, else by a shuffle."""
    ids = F.broadcast(ids) if most <= BROADCAST_IDS else ids
    return cut(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; component_id is the smallest id reachable by links."""
    texts = docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    found = cut(features(docs, id, text, shingle))
    limit, sketch = far(similarity), [f"s{k}" for k in range(LANES)]
    # classes of equal sets, known by their smallest document
    live = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    head = F.min(F.struct("doc_id", "bands", *sketch)).alias("head")
    classes = live.groupBy("n_shingles", "set_a", "set_b").agg(head, F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select("n_shingles", "set_a", "set_b", "copies", "head.*").withColumnRenamed("doc_id", "rep"))
    heads = classes if classes.groupBy("rep").count().where("count > 1").isEmpty() else classes.dropDuplicates(["rep"])
    # members of buckets, each with the bucket's smallest
    rows = heads.select("rep", "n_shingles", F.explode("bands").alias("key"))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / (BLOCK * 256))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n"), size.alias("size")).where("n > 1")
    rows = cut(rows.select("key", "rep").join(cut(buckets), "key"))
    edges = rows.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).repartition("a").distinct()
    lanes = heads.select("rep", *sketch)
    near = edges.join(lanes.withColumnRenamed("rep", "a").alias("x"), "a").join(lanes.withColumnRenamed("rep", "b").alias("y"), "b").where(_apart("x", "y") <= limit)
    near = cut(near.select("a", "b"))
    asked = _texts(texts, near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), 2 * near.count())
    labels = components(cut(_confirmed(near, asked, shingle, similarity)))  # cut: so that no task needs two workers at once
    # what hubs cannot show: buckets of three or more that hold several components once the hubs' links are known
    members = _labelled(rows.where("n > 2"), labels)
    mixed = cut(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    if not mixed.isEmpty():
        members = members.join(mixed, "key", "left_semi").select("key", "hub", "size", "rep", "component")
        active = cut(_active(members.join(heads.select("rep", "n_shingles", "bands", *sketch), "rep"), limit, similarity))
        links = _block_links(active, _texts(texts, active.select(F.col("rep").alias("doc_id")).distinct(), active.count()), shingle, similarity)
        labels = _merged(labels, cut(links))
    # back to the documents: only classes that are not just one document of its own component have something to say
    named = _labelled(classes.select("n_shingles", "set_a", "set_b", "copies", "rep"), labels).where("copies > 1 OR component <> rep").select("n_shingles", "set_a", "set_b", "component")
    out = found.select("doc_id", "n_shingles", "set_a", "set_b").join(cut(named), ["n_shingles", "set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links: the stars so far stand for the links that made them."""
    if links.isEmpty():
        return labels
    return components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; of repeated rows with that id all stay."""
    (key,) = fresh(docs, "key")
    gone = cut(near_duplicates(docs, id, text, shingle, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, column(id) == F.col(key), "left_anti")
