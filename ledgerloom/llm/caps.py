"""Embedding near-dedup by spherical-cap filters.

Filters are the directions of some structured random product codes (tables): a
direction is a code word for each half of the (randomly rotated) coordinates,
``words`` ** 2 of them a table.  A vector is list-decoded to all directions
whose inner product with it is at least ``eta / sqrt(dimension)``: only pairs of
code words that can reach it are looked at.  Vectors that share a filter are
candidates.  ``Filters.of`` has more and smaller caps the more vectors there
are, in levels: with four times the vectors two of them meet by chance about a
quarter as often.  The tails of a sphere are thinner than normal ones, so the
levels end at the last that keeps the recall: two vectors at a cosine of 0.9
share no filter less than once in a hundred times at every level, nearer ones
less often (the tests measure it).  Beyond a million vectors the caps stay as
they are, and a vector meets others by chance in proportion to their number.

Verification, without all pairs of a bucket leaving it:
1. Equal vectors form a class, represented by the smallest id, with its size.
2. Within a filter's bucket (in blocks, see below) members are compared by
   256-bit sign sketches.  A member with a near one leaves the block as one row;
   where the bucket's smallest member, its hub, is near, the pair of both is a
   candidate, taken once whatever number of filters they share.
3. Candidates are verified by their cosine in double precision; the components
   of those that hold make copies of one vector one group.
4. A bucket whose rows are by now one component has nothing left to show.  In
   the others, members that are near by sketch and of different components come
   to their block with their vectors, where the cosines between components are
   taken; only links that join two components leave it.
5. By then components are final.  Within each, in blocks, the cosines of all
   pairs are taken and each member's links counted.
So what is compared in full is a candidate of the filters or of one component of
links; nothing is joined because it is only loosely similar.

Growth.  A bucket or component of n members is dealt into parts of about 4 *
sqrt(n) members, from ``LEAST`` to ``MOST``, and into each pair of parts: to n * n /
MOST rows for the largest.  Counting links takes all pairs of a component, which
is what it has to count.

Defined cases: a vector that is null, empty, zero, or has a null, infinite or
NaN component links with nothing, and so does one with a null id, whose
component is null; vectors of different lengths are not compared; repeated
rows are vectors each; rows of one id with several vectors are known by one of
them; a pair at the threshold is a link; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import textops
from ledgerloom.llm.common import column, cut, mapped
from ledgerloom.operators.components import components

COSINE = 0.9
LEAST_DIMENSION = 64  # shorter vectors are padded with zeros, which keeps their cosines
LANES = 4
#: Members of a part, at least and at most.
LEAST, MOST = 128, 2048
ETAS = (3.75, 4.0, 4.25, 4.5, 4.7)  # of the levels, each found by measuring recall at 64 dimensions
DECODED = 1 << 19  # inner products in one step of the decoding

FEATURES = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("valid", T.BooleanType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("key_a", T.LongType()),
    T.StructField("key_b", T.LongType()),
    T.StructField("filters", T.ArrayType(T.LongType(), False)),
    *[T.StructField(f"s{k}", T.LongType()) for k in range(LANES)],
    T.StructField("unit", T.BinaryType()),
])
_codes: dict[tuple, tuple] = {}


@dataclass(frozen=True)
class Filters:
    tables: int
    words: int
    eta: float

    @classmethod
    def of(cls, n: int) -> Filters:
        """The filters for n vectors."""
        level = min(len(ETAS) - 1, max(0, math.ceil(math.log(max(n, 1) / 4000, 4))))
        return cls(6 + 2 * level, 512 << level, ETAS[level])


def _code(d: int, f: Filters) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each table the two halves' code words, rotated back; and the sketch's planes."""
    if (d, f) not in _codes:
        rng = np.random.Generator(np.random.PCG64(1000 + d))
        planes, tables = rng.standard_normal((d, 64 * LANES)), []
        for _ in range(f.tables):
            rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
            words = [rng.standard_normal((f.words, n)) for n in (d // 2, d - d // 2)]
            words = [w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(2) for w in words]
            tables.append((rotation[:, : d // 2] @ words[0].T, rotation[:, d // 2 :] @ words[1].T))
        _codes.clear()
        _codes[d, f] = tables, planes
    return _codes[d, f]


def _widened(unit: np.ndarray) -> np.ndarray:
    n, d = unit.shape
    return unit if d >= LEAST_DIMENSION else np.concatenate([unit, np.zeros((n, LEAST_DIMENSION - d))], axis=1)


def decode(unit: np.ndarray, f: Filters) -> list[np.ndarray]:
    """The numbers of all filters that each unit vector exceeds."""
    unit = _widened(unit)
    n, d = unit.shape
    tables, _ = _code(d, f)
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    least, step = f.eta / np.sqrt(d), max(1, DECODED // f.words)
    for at in range(0, n, step):
        part = unit[at : at + step]
        for t, (left, right) in enumerate(tables):
            a, b = part @ left, part @ right
            # code words of either half that can reach the threshold with the best of the other half
            can_a, can_b = a >= least - b.max(axis=1, keepdims=True), b >= least - a.max(axis=1, keepdims=True)
            for i in np.flatnonzero(can_a.any(axis=1) & can_b.any(axis=1)).tolist():
                p, q = np.flatnonzero(can_a[i]), np.flatnonzero(can_b[i])
                x, y = np.nonzero(a[i, p][:, None] + b[i, q] >= least)
                out[at + i].append((t * f.words + p[x]) * f.words + q[y])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def features(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """FEATURES of each vector."""
    f = Filters.of(vectors.count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                yield _features(b.slice(at, 2048), f)

    return mapped(vectors.select(column(id).cast("long").alias("vec_id"), column(embedding).cast("array<double>").alias("embedding")), task, FEATURES)


def _features(b: pa.RecordBatch, f: Filters) -> pa.RecordBatch:
    n = b.num_rows
    cells = b.column(1)
    flat, size = cells.flatten(), np.zeros(n, np.int64)
    lengths = cells.value_lengths().fill_null(0).to_numpy()
    size[:] = lengths
    start = np.concatenate([[0], np.cumsum(size)])
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    valid, keys = np.zeros(n, bool), np.zeros((n, 2), np.int64)
    filters: list = [()] * n
    sketch, units = np.zeros((n, LANES), np.int64), [None] * n
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = values[start[rows][:, None] + np.arange(d)] + 0.0  # no negative zeros
        with np.errstate(all="ignore"):
            big = np.abs(x).max(axis=1)
            ok = np.isfinite(x).all(axis=1) & (big > 0)
        rows, x, big = rows[ok], x[ok], big[ok]
        if not len(rows):
            continue
        unit = x / big[:, None]  # so that squares neither overflow nor vanish
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        valid[rows] = True
        bits = x.view(np.uint64)
        for k in range(2):
            keys[rows, k] = textops.mix(bits + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)).sum(axis=1, dtype=np.uint64).view(np.int64)
        wide = _widened(unit)
        signs = wide @ _code(wide.shape[1], f)[1] > 0
        sketch[rows] = np.packbits(signs, axis=1, bitorder="little").view("<i8")
        for r, numbers, u in zip(rows.tolist(), decode(unit, f), unit, strict=True):
            filters[r] = numbers + (d << 40)
            units[r] = u.tobytes()
    count = np.array([len(x) for x in filters])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(np.concatenate([*filters, np.zeros(0, np.int64)]).astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(valid), pa.array(size, pa.int32()), *map(pa.array, np.ascontiguousarray(keys.T)), lists, *map(pa.array, np.ascontiguousarray(sketch.T)), pa.array(units, pa.binary())],
        [x.name for x in FEATURES],
    )


def sketch_limit(cosine: float) -> int:
    """The Hamming distance of sketches that pairs of at least this cosine exceed about once in three million times."""
    n, p = 64 * LANES, np.arccos(cosine) / np.pi
    return int(n * p + 5 * np.sqrt(n * p * (1 - p)))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (rep, n, ..), n the members of the row's group, dealt into pairs p <= q of parts."""
    size = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 4 * F.sqrt("n")))
    dealt = rows.withColumn("parts", F.ceil(F.col("n") / size).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("n", "parts", "other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Runs of whole groups, as columns: the rows come sorted by the first three."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if not len(now[0]):
            continue
        held.append(now)
        last = [c[-1] for c in now[:3]]
        whole = np.flatnonzero((now[0] != last[0]) | (now[1] != last[1]) | (now[2] != last[2]))
        if len(whole):
            end = whole[-1] + 1
            held[-1] = [c[:end] for c in now]
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [[c[end:] for c in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _near(rows: DataFrame, limit: int) -> DataFrame:
    """(key, rep, hub, by_hub) of the members of a bucket with a near one by sketch in some block; by_hub: the hub is.

    rows: key, hub, n, rep, s0 ..
    """
    names = ["key", "p", "q", "part", "rep", "hub", *[f"s{k}" for k in range(LANES)]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, p, q, part, rep, hub, *lanes in _groups(batches):
            sketch = np.stack(lanes, axis=1).view(np.uint64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(start, size))  # rows of the group from this one on
            some, by_hub = np.zeros(len(key), bool), np.zeros(len(key), bool)
            for step in range(1, int(size.max(initial=0))):
                i = np.flatnonzero(left > step)
                near = np.bitwise_count(sketch[i] ^ sketch[i + step]).sum(axis=1, dtype=np.int64) <= limit
                near &= (part[i] != part[i + step]) | (p[i] == q[i])
                i = i[near]
                j = i + step
                some[i] = some[j] = True
                by_hub[i] |= rep[j] == hub[j]
                by_hub[j] |= rep[i] == hub[i]
            rows_ = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows_]) for x in (key, rep, hub, by_hub)], ["key", "rep", "hub", "by_hub"])

    dealt = _dealt(rows).select(*names).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return mapped(dealt, task, "key long, rep long, hub long, by_hub boolean")


def _confirmed(pairs: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) whose vectors have at least this cosine."""
    left = pairs.join(units.select(F.col("rep").alias("a"), F.col("unit").alias("x")), "a")
    both = left.join(units.select(F.col("rep").alias("b"), F.col("unit").alias("y")), "b").select("a", "b", "x", "y")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.array([float(np.frombuffer(x) @ np.frombuffer(y)) >= cosine if len(x) == len(y) else False for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return mapped(both, task, "a long, b long")


def _units(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(group.num_rows, -1)


def _across(members: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) between components, enough to join all that are linked within a block; members: key, n, rep, component, unit."""

    def task(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, part = (group.column(c).to_numpy() for c in ("rep", "part"))
        label = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        p, q = key[1].as_py(), key[2].as_py()
        i, j = np.flatnonzero(part == p), np.flatnonzero(part == q)
        unit = _units(group)
        near = (unit[i] @ unit[j].T >= cosine) & (label[i][:, None] != label[j])
        a, b = [], []
        for x, y in zip(*(at[k].tolist() for at, k in zip((i, j), np.nonzero(near), strict=True)), strict=True):
            if label[x] != label[y]:
                a.append(int(max(rep[x], rep[y])))
                b.append(int(min(rep[x], rep[y])))
                label[label == label[y]] = label[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(members).groupBy("key", "p", "q").applyInArrow(task, "a long, b long")


def _links(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, n) of each member of a component with links in a block; members: component, n, rep, copies, unit."""

    def task(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, copies, part = (group.column(c).to_numpy() for c in ("rep", "copies", "part"))
        unit = _units(group)
        p, q = key[1].as_py(), key[2].as_py()
        i, j = np.flatnonzero(part == p), np.flatnonzero(part == q)
        near = unit[i] @ unit[j].T >= cosine
        if p == q:
            near &= np.triu(np.ones(near.shape, bool), 1)
        a, b = (x[y] for x, y in zip((i, j), np.nonzero(near), strict=True))
        n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        some = np.flatnonzero(n)
        return pa.table({"rep": rep[some], "n": n[some].astype(np.int64)})

    return _dealt(members).select("component", "p", "q", "part", "rep", "copies", "unit").groupBy("component", "p", "q").applyInArrow(task, "rep long, n long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (.., rep) with the component of each, rep itself where it is on no edge."""
    named = labels.select(F.col("node").alias("rep"), "component")
    return members.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    found, sketch, limit = cut(features(vectors, id, embedding)), [f"s{k}" for k in range(LANES)], sketch_limit(cosine)
    live = found.where(F.col("valid") & F.col("vec_id").isNotNull())
    head = F.min(F.struct(F.col("vec_id").alias("rep"), "filters", "unit", *sketch)).alias("head")
    classes = cut(live.groupBy("dim", "key_a", "key_b").agg(head, F.count(F.lit(1)).alias("copies")).select("dim", "key_a", "key_b", "copies", "head.*"))
    heads = classes.select("rep", "copies", "filters", "unit", *sketch)
    if not heads.groupBy("rep").count().where("count > 1").isEmpty():  # rows of one id with several vectors
        heads = heads.dropDuplicates(["rep"])
    rows = heads.select("rep", F.explode("filters").alias("key"), *sketch)
    buckets = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = cut(_near(rows.join(cut(buckets), "key"), limit))
    units = heads.select("rep", "unit")
    pairs = near.where("by_hub AND rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).repartition("a").distinct()
    labels = components(cut(_confirmed(pairs, units, cosine)))
    # what hubs cannot show
    members = _labelled(near.select("key", "rep").distinct(), labels)
    mixed = cut(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n"))
    if not mixed.isEmpty():
        members = members.join(mixed, "key").join(units, "rep")
        links = cut(_across(members.select("key", "n", "rep", "component", "unit"), cosine))
        if not links.isEmpty():
            stars = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(stars.union(links))
    labels = cut(labels.select(F.col("node").alias("rep"), "component"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = labels.join(cut(sizes), "component").join(heads.select("rep", "copies", "unit"), "rep")
    counts = _links(members, cosine).groupBy("rep").agg(F.sum("n").alias("links"))
    named = classes.select("dim", "key_a", "key_b", "copies", "rep").join(labels, "rep", "left").join(counts, "rep", "left").where("copies > 1 OR component IS NOT NULL")
    out = found.select("vec_id", "valid", "dim", "key_a", "key_b").join(cut(named), ["dim", "key_a", "key_b"], "left")
    linked = F.col("valid") & F.col("vec_id").isNotNull()
    return out.select(
        "vec_id",
        F.when(linked, F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(linked, F.coalesce("component", "rep", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
