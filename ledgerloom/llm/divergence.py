"""Source divergence audit: which sources of a language write alike, and which terms set a source apart.

A term is a run of letters (of any alphabet), A-Z lower-cased.  A language keeps
the terms that stand in ``MIN_DOCS`` of its documents at least.  Each group, a
source within a language, and each language gives each kept term a smoothed
probability in units of 1 / ``UNIT``, and two probabilities p and q lie
``(p - q) ** 2 div (p + q)`` apart.  All of it is whole numbers.

``terms`` finds a group's ``top`` terms by upper bounds.  Terms of the same
count in the group have the same p, so they make a bucket, of which only the
least and the largest count in the whole language are kept.  The value falls as
q comes nearer to p, so the least one bounds all values of a bucket.  The
buckets are evaluated best first: those that hold the first ``top`` terms in the
order of their bounds are opened, which gives a k-th best value; every other
bucket that is not strictly below it is opened too, and all that is left unseen
cannot be among the best, not even as a tie.

``pairs`` adds up the values of two sources over all kept terms by their
postings.  Sources are dealt into blocks of about ``BLOCK`` by a hash, terms
into ``PARTS``; a task takes the postings of two blocks sorted by term, makes a
small table of the sources' probabilities for a few terms at a time, and sums.
Terms that neither block holds are the same for all and are added at the end.

Plan: a task counts a batch's terms before anything is shuffled, Spark adds up
the counts by (language, source, term) with map-side sums, and from there on
data are as large as the vocabulary of each group.  Statistics of a group are
joined with its buckets, not with its terms; where they have to be joined with
terms, the join is salted.  The result holds each pair of sources of a language,
which is what is asked for; nothing else is quadratic.

Defined cases: a null text, language or source counts as an empty one; a group
without terms, or of a language that keeps none, has pairs of value 0 and no
terms; a source that is alone in its language has no pairs; equal values are
ranked by the item's bytes; repeated rows are documents each; an empty table
gives no rows; other columns are not looked at.  Terms of one batch are told
apart by 64-bit hashes (a batch of 4 MB confuses two of them with probability
4e-9), those of different batches by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.arrow import mapped
from ledgerloom.checkpoints import cut
from ledgerloom.llm import textops
from ledgerloom.llm.common import LOWER, UPPER, column

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Added to each count.
SMOOTH = 2
#: Sources of a block, on average; parts of the terms; cells of a task's table of probabilities.
BLOCK, PARTS, CELLS = 128, 16, 1 << 18
SALTS = 16
#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTER = ~textops.class_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

COUNTED = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, a string, b string, met long, total long"


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of the bytes as an array of strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    picked = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(picked)).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of each run of texts."""
    for batch in batches:
        langs, sources = (batch.column(k).fill_null("").dictionary_encode() for k in range(2))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        data, offsets = textops.buffers(batch.column(2))
        for i, j in textops.slices(offsets, 4 * textops.SEGMENT):
            part = textops.lowered(data[offsets[i] : offsets[j]])
            starts, ends, first = textops.words(part, offsets[i : j + 1] - offsets[i], LETTER)
            _, shown, code = np.unique(textops.word_hashes(part, starts, ends), return_index=True, return_inverse=True)
            if not len(shown):
                continue
            owner = textops.owners(first)
            keys, n = np.unique(owner * len(shown) + code, return_counts=True)  # of a document
            owner, term = np.divmod(keys, len(shown))
            both = group[i + owner] * len(shown) + term
            found, at = np.unique(both, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, at, n)
            g, term = np.divmod(found, len(shown))
            lang, source = np.divmod(g, max(1, len(sources.dictionary)))
            names = _strings(part, starts[shown], ends[shown])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), names.take(pa.array(term)), pa.array(total), pa.array(np.bincount(at, minlength=len(found)))],
                ["lang", "source", "term", "n", "docs"],
            )


def probability(count: str, whole: str, terms: str) -> Column:
    """1 + UNIT * (count + SMOOTH) div (whole + SMOOTH * terms), by decimals of 38 digits."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"1 + {wide(f'{count} + {SMOOTH}')} * cast({UNIT} as decimal(10, 0)) div {wide(f'{whole} + {SMOOTH} * {terms}')}").cast("long")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


class Audit:
    """The kept terms' counts of a table of documents, by group and by language."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> None:
        named = [F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
        rows = docs.select(*named, column(text).alias("text"))
        counted = mapped(rows, _count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= min_docs)
        # both sides have the same columns, so they come from one shuffle of the counts
        joined = counted.join(kept, ["lang", "term"]).where(F.col("docs") > 0)
        #: (lang, source, term, n, lang_n)
        self.postings = cut(joined.select("lang", "source", "term", "n", "lang_n"))
        groups = docs.select(*named).distinct()
        held = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
        langs = self.postings.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_whole"))
        groups = groups.join(held, ["lang", "source"], "left").join(langs, "lang", "left")
        #: (lang, source, whole, terms, lang_whole): occurrences of kept terms, and how many there are
        self.groups = cut(groups.fillna(0))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a group holds and gives a larger probability than its language."""
        buckets = self.postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("size"), F.min("lang_n").alias("lang_n"))
        buckets = buckets.join(self.groups, ["lang", "source"])
        buckets = buckets.withColumn("p", probability("n", "whole", "terms")).withColumn("q", probability("lang_n", "lang_whole", "terms"))
        buckets = buckets.where("p > q").withColumn("bound", apart("p", "q")).drop("q", "lang_n", "whole")
        before = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        buckets = cut(buckets.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)) < top))
        seen = self._opened(buckets.where("first"))
        ranked = self._best(seen, top).where(F.col("rank") == top).select("lang", "source", F.col("value").alias("least"))
        rest = buckets.where("NOT first").join(ranked, ["lang", "source"], "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))
        return self._best(seen.unionByName(self._opened(rest)), top)

    def _opened(self, buckets: DataFrame) -> DataFrame:
        """(lang, source, item, value) of the buckets' terms."""
        some = buckets.select("lang", "source", "n", "p", "terms", "lang_whole")
        rows = self.postings.join(some, ["lang", "source", "n"]).withColumn("q", probability("lang_n", "lang_whole", "terms")).where("p > q")
        return rows.select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))

    @staticmethod
    def _best(rows: DataFrame, top: int) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of the language by its distance, the largest first."""
        blocks = self.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        zero = F.when(F.col("terms") > 0, probability("0", "whole", "greatest(terms, 1)")).otherwise(F.lit(1).cast("long"))
        groups = self.groups.join(blocks, "lang").withColumn("blocks", F.ceil(F.col("sources") / BLOCK).cast("long")).withColumn("zero", zero)
        groups = cut(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).select("lang", "source", "whole", "terms", "blocks", "block", "zero"))
        # a block meets itself and each other one once
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        meets = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
        heads = groups.select("*", other.alias("other")).select("lang", *meets, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "source", "block", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
        rows = self.postings.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "source", "salt"])
        rows = rows.withColumn("p", probability("n", "whole", "terms")).select("*", other.alias("other")).select("lang", *meets, part.alias("part"), "source", "block", "term", "p")
        keys = ["lang", "lo", "hi", "part"]
        dealt = heads.unionByName(rows).repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term"))
        sums = mapped(dealt, _sums(CELLS), SUMS).groupBy("lang", "a", "b").agg(F.sum("met").alias("met"), F.sum("total").alias("total"))
        both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "met", "total").union(sums.select("lang", "b", "a", "met", "total"))
        zeros = groups.select("lang", "source", "zero", "terms")
        both = both.join(zeros, ["lang", "source"]).join(zeros.select("lang", F.col("source").alias("item"), F.col("zero").alias("other")), ["lang", "item"])
        value = (F.col("total") + (F.col("terms") - F.col("met")) * apart("zero", "other")).alias("value")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return both.select("lang", "source", "item", value).withColumn("rank", F.row_number().over(order))


class _Sums:
    """Sums of two blocks of sources over one part of the terms, whose rows come in the order of the terms."""

    def __init__(self, key: tuple, cells: int) -> None:
        self.key, self.cells = key, cells
        self.names: list[str] = []
        self.second: list[bool] = []
        self.zero: list[int] = []
        self.ready = False
        self.met, self.row = 0, -1
        self.last: str | None = None

    def heads(self, sources: list[str], blocks: list[int], zeros: list[int]) -> None:
        """The sources, and what each gives a term that it does not hold."""
        self.names += sources
        self.second += [b != self.key[1] for b in blocks]
        self.zero += zeros

    def _begin(self) -> None:
        self.ready = True
        self.at = {name: k for k, name in enumerate(self.names)}
        second = np.array(self.second, bool)
        alone = self.key[1] == self.key[2]
        self.a, self.b = (np.arange(len(second)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))
        self.table = np.tile(np.array(self.zero, np.int64), (max(1, self.cells // max(1, len(self.a) * len(self.b))), 1))
        self.total = np.zeros((len(self.a), len(self.b)), np.int64)

    def add(self, sources: pa.Array, terms: pa.Array, p: np.ndarray) -> None:
        if not self.ready:
            self._begin()
        sources, terms = sources.dictionary_encode(), terms.dictionary_encode()
        at = np.array([self.at[x] for x in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()]
        code = terms.indices.to_numpy()
        new = np.concatenate([[terms[0].as_py() != self.last], code[1:] != code[:-1]])
        self.last, self.met = terms[-1].as_py(), self.met + int(new.sum())
        row, i = self.row + np.cumsum(new), 0
        while i < len(row):
            j = int(np.searchsorted(row, len(self.table)))
            self.table[row[i:j], at[i:j]] = p[i:j]
            if j < len(row):
                self._flush(len(self.table))
                row -= len(self.table)
            i = j
        self.row = int(row[-1])

    def _flush(self, n: int) -> None:
        p, q = self.table[:n, self.a, None], self.table[:n, None, self.b]
        self.total += ((p - q) ** 2 // (p + q)).sum(0)
        self.table[:n] = self.zero

    def result(self) -> pa.RecordBatch:
        if not self.ready:
            self._begin()
        self._flush(self.row + 1)
        x, y = np.triu_indices(len(self.a), 1) if self.key[1] == self.key[2] else (g.ravel() for g in np.indices(self.total.shape))
        names = pa.array(self.names, pa.string())
        columns = [pa.array([self.key[0]] * len(x), pa.string()), names.take(pa.array(self.a[x])), names.take(pa.array(self.b[y])), pa.array(np.full(len(x), self.met)), pa.array(self.total[x, y])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "met", "total"])


def _sums(cells: int):  # noqa: ANN202
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Sums | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(0).dictionary_encode().indices.to_numpy(), *(batch.column(k).to_numpy() for k in (1, 2, 3))]
            begins = np.concatenate([[0], 1 + np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)), [batch.num_rows]])
            for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                key = tuple(batch.column(k)[i].as_py() for k in range(4))
                if now is None or now.key != key:
                    if now is not None:
                        yield now.result()
                    now = _Sums(key, cells)
                run = batch.slice(i, j - i)
                first = run.column(6).null_count
                if first:
                    now.heads(*(run.column(k)[:first].to_pylist() for k in (4, 5, 7)))
                if first < j - i:
                    now.add(run.column(4)[first:], run.column(6)[first:], run.column(7)[first:].to_numpy())
        if now is not None:
            yield now.result()

    return task


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source, part ``term`` the terms that stand out."""
    found = Audit(docs, text, lang, source, min_docs)
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in (("pair", found.pairs()), ("term", found.terms(top)))]
    return parts[0].unionByName(parts[1])


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '[^" + "".join(chr(92) + x for x in ("x00-", "x40", "x5B-", "x60", "x7B-", "x7F")) + "]+')"


def _share(count: str, whole: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({count} + {SMOOTH})) // ({whole} + {SMOOTH} * v))"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT lang, source, k.term, coalesce(c.c, 0) AS c, {_share("coalesce(c.c, 0)", "coalesce(s.n, 0)")} AS p, {_share("k.c", "l.n")} AS q
  FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
),
values_ AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN values_ v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
