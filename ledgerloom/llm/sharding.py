"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's
fractional rank is (rank + phase) / rows of the source, the phase being a
seeded number in [0, 1) of the source, so that small sources do not all fall on
the same place.  All rows are put in the order of their fractional ranks, and
that order is cut into shards whose counts differ by one at most.  Any stretch
of the order holds each source in its share, to within a row or two.

Plan: no rank is made over a whole source and no order over the whole table.
Rows are dealt by the first digits of their hash into ``BUCKETS`` even parts of
each source, ranked within a part, and added to the running count of the parts
before it (``BUCKETS`` rows a source).  Fractional ranks are spread evenly by
construction, so the whole order is made in the same way over ``BUCKETS`` even
ranges of them.  A source with a third of all rows is thus as many parts as any
other.  The counts of either step come from the keys alone; whole rows are
shuffled twice.

Defined cases: a null or empty text is a text without bytes; a null source is a
source of its own, a null id an id of its own; rows of one id are told apart by
their text, rows that are the same in id and text by their other columns (of
which maps do not count) and get a place each; an empty table gives an empty
table; columns that are named like an added one are replaced, in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import column, fresh

SHARDS = 16
SEED = 20
#: Parts of a source, and ranges of fractional ranks; a power of two up to 1 << 16.
BUCKETS = 1 << 14


def size(text: Column) -> Column:
    """Bytes of a text in UTF-8, and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType | T.VariantType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _before(counts: DataFrame, by: list[str], order: str, n: str, first: str, whole: str) -> DataFrame:
    """counts with the sum of n before each row, and over all rows of ``by``."""
    group = Window.partitionBy(*by)
    return counts.withColumn(first, F.sum(n).over(group.orderBy(order)) - F.col(n)).withColumn(whole, F.sum(n).over(group)).drop(n)


def interleave(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``docs`` with the number of each row's shard and its place there, both from 0."""
    docs = docs.drop(*[column(c) for c in docs.columns if c.lower() in {n.lower() for n in names}])
    stratum, key, tie, part, n, first, whole, rank, at = fresh(docs, "stratum", "key", "tie", "part", "n", "first", "whole", "rank", "at")
    seeded = F.lit(f"{seed}")
    rows = docs.withColumns({
        stratum: F.md5(F.concat_ws(":", seeded, F.coalesce(F.concat(F.lit("s"), column(source).cast("string")), F.lit("n")))),
        key: F.md5(F.concat_ws(":", seeded, column(id).cast("string"), F.md5(F.coalesce(column(text).cast("binary"), F.lit(b""))))),
        tie: F.xxhash64(*[column(f.name) for f in docs.schema if not _has_map(f.dataType)]),
    }).withColumn(part, F.floor(_hex(F.substring(key, 1, 4)) / ((1 << 16) // BUCKETS)).cast("int"))
    # the rank within the source
    counts = rows.groupBy(stratum, part).agg(F.count(F.lit(1)).alias(n))
    ranked = rows.join(_before(counts, [stratum], part, n, first, whole), [stratum, part])
    within = F.row_number().over(Window.partitionBy(stratum, part).orderBy(key, tie))
    phase = _hex(F.substring(stratum, 1, 8)) / float(1 << 32)
    ranked = ranked.withColumn(rank, F.col(first) + within).withColumn(at, ((F.col(rank) - 1) + phase) / F.col(whole)).drop(first, whole, rank, part)
    ranked = ranked.withColumn(part, F.least(F.floor(F.col(at) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    # the place in the whole order
    counts = ranked.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    placed = ranked.join(_before(counts, [], part, n, first, whole), part)
    place = F.col(first) + F.row_number().over(Window.partitionBy(part).orderBy(at, stratum, key, tie)) - 1
    placed = placed.withColumn(rank, place.cast("long")).withColumn(names[0], F.expr(f"cast({rank} * {shards} div {whole} as int)"))
    begin = F.expr(f"({names[0]} * {whole} + {shards - 1}) div {shards}")
    placed = placed.withColumn(names[1], (F.col(rank) - begin).cast("long"))
    return placed.select(*[column(c) for c in docs.columns], *names)


def write(sharded: DataFrame, folder: str, names: tuple[str, str] = ("shard", "slot")) -> None:
    """A folder of Parquet files for each shard (``shard=0`` ..), whose files hold the shard's rows in the order of their slots."""
    shard, slot = names
    sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)


def _table() -> list[int]:
    """The checksum's remainders of 4 bits."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, md5(concat_ws(':', '{SEED}', coalesce('s' || source, 'n'))) AS stratum,
    md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS k
  FROM documents
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM d),
fractions AS (SELECT *, ((r - 1)::DOUBLE + ('0x' || substr(stratum, 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE) / n::DOUBLE AS f FROM ranked),
placed AS (SELECT *, row_number() OVER (ORDER BY f, stratum, k) - 1 AS p, count(*) OVER () AS total FROM fractions),
sharded AS (SELECT *, p * {SHARDS} // total AS shard FROM placed),
pairs AS (SELECT doc_id, regexp_extract_all(hex(encode(body)), '..') AS b FROM d),
nibbles AS (SELECT doc_id, flatten(list_transform(b, lambda x: [strpos('123456789ABCDEF', x[2]), strpos('123456789ABCDEF', x[1])]))::BIGINT[] AS n FROM pairs),
sums AS (SELECT doc_id, xor(list_reduce(n, lambda c, x: xor(c >> 4, {_table()}[1 + xor(c, x) % 16]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM nibbles)
SELECT doc_id, strlen(body)::BIGINT + 1 AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (p - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sharded JOIN sums USING (doc_id)
"""
