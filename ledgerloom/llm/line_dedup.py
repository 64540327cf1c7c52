"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host when the pages that hold it, divided by all
pages of the host, exceed ``max_ratio``, and when it stands on ``min_pages``
pages at least: on one page alone, the default says, nothing is repeated.
Boilerplate lines go from every page of that host; the others keep their order.
A page of boilerplate alone is left with an empty text, or as it is if
``keep_whole`` says so (where whole copies are dealt with later).

Plan: lines are made distinct within their page, so a plain count is a page
count; counts are keyed by (host hash, line hash), so map-side sums fold a hot
line of a hot host before the shuffle.  What survives the ratio is at most
(lines per page / max_ratio) lines a host.  It goes back to the pages as one
array a host: by a broadcast when its measured size allows, else by a join
salted over ``SALTS`` parts, so that a host with a third of all pages is
spread.  Texts are shuffled only in that last case.

Defined cases: a null text stays null and has no lines; blank lines are never
counted or dropped; lines are compared without leading and trailing spaces; a
null host is a host of its own; repeated rows count as pages each; a line at
just the ratio stays; a page without any line but blank ones stays as it is; an
empty table gives an empty table.  Lines are compared by 64-bit hashes within a
host, itself a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import column, cut, fresh

MAX_RATIO = 0.1
MIN_PAGES = 2
#: Up to so many boilerplate lines (12 to 16 bytes each) are broadcast.
BROADCAST_LINES = 500_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line)


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_hash, line_hash, n_pages, host_pages) of the lines to drop."""
    hashed = F.xxhash64(column(host)).alias("host_hash")
    hosts = pages.groupBy(hashed).agg(F.count(F.lit(1)).alias("host_pages"))
    bare = F.array_distinct(F.transform(_lines(column(text)), _bare))
    counts = (
        pages.where(column(text).isNotNull())
        .select(hashed, F.explode(bare).alias("line"))
        .where(F.col("line") != "")
        .groupBy("host_hash", F.xxhash64("line").alias("line_hash"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        counts.withColumn("salt", F.pmod("line_hash", F.lit(SALTS)).cast("int"))
        .join(salted, ["host_hash", "salt"])
        .where(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages"))
        .select("host_hash", "line_hash", "n_pages", "host_pages")
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False, counts: tuple[str, str] | None = None
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; all other columns stay.

    counts: names of two added columns, the page's lines that are not blank and those of them dropped.
    """
    lines = cut(boilerplate(pages, host, text, max_ratio, min_pages).select("host_hash", "line_hash"))
    few = lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    hosts = lines.groupBy("host_hash").agg(F.collect_list("line_hash").alias("drops"))
    key, drops, hits, gone, salt = fresh(pages, "host", "drops", "hits", "gone", "salt")
    hosts = hosts.select(F.col("host_hash").alias(key), F.col("drops").alias(drops))
    keyed = pages.withColumn(key, F.xxhash64(column(host)))
    if few:
        joined = keyed.join(F.broadcast(hosts), key, "left")
    else:
        spread = hosts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(column(text)), F.lit(SALTS)).cast("int")).join(spread, [key, salt], "left").drop(salt)
    body = column(text)
    hashes = F.transform(_lines(body), lambda x: F.xxhash64(_bare(x)))
    dropped = lambda x: F.array_contains(F.col(hits), F.xxhash64(_bare(x)))
    some = F.size(hits) > 0
    n_dropped = F.when(some, F.size(F.filter(_lines(body), dropped))).otherwise(0)
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(F.filter(_lines(body), lambda x: _bare(x) != "")))
    # hits: the few line hashes of this page that are boilerplate, by a hash lookup and not a scan for each line
    marked = joined.withColumn(hits, F.when(F.col(drops).isNotNull() & body.isNotNull(), F.array_intersect(hashes, F.col(drops))).otherwise(F.array().cast("array<bigint>")))
    marked = marked.withColumn(gone, (some & (n_dropped < n_lines)) if keep_whole else some)
    out = [c for c in pages.columns]
    made = marked
    if counts:
        made = made.withColumn(counts[0], n_lines.cast("long")).withColumn(counts[1], F.when(F.col(gone), n_dropped).otherwise(0).cast("long"))
        out += list(counts)
    kept = F.when(F.col(gone), F.array_join(F.filter(_lines(body), lambda x: ~dropped(x)), "\n")).otherwise(body)
    return made.withColumn(text, kept).select(*[column(c) for c in out])


ORACLE_SQL = f"""
WITH hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
lines AS (
  SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line
  FROM documents WHERE text IS NOT NULL
),
drops AS (
  SELECT l.source, list(l.line) AS drops FROM (
    SELECT source, line, count(*) AS c FROM lines WHERE line <> '' GROUP BY source, line HAVING count(*) >= {MIN_PAGES}
  ) l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.c > {MAX_RATIO}::DOUBLE * h.n GROUP BY l.source
),
marked AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce(drops, []) AS drops
  FROM documents d LEFT JOIN drops r ON d.source IS NOT DISTINCT FROM r.source
),
counted AS (
  SELECT doc_id, text, ls, drops,
    coalesce(len(list_filter(ls, lambda x: trim(x, ' ') <> '')), 0) AS n_lines,
    coalesce(len(list_filter(ls, lambda x: list_contains(drops, trim(x, ' ')))), 0) AS hit
  FROM marked
),
kept AS (
  SELECT doc_id, n_lines, hit AS n_dropped, hit > 0 AND hit = n_lines AS all_dropped,
    CASE WHEN hit > 0
      THEN array_to_string(list_filter(ls, lambda x: NOT list_contains(drops, trim(x, ' '))), chr(10)) ELSE text END AS text
  FROM counted
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, all_dropped,
  coalesce(length(text), 0)::BIGINT AS kept_chars, md5(text) AS kept_md5
FROM kept
"""
