"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, give the
probability of each character after the ``ORDER`` characters before it.  They
are Witten-Bell smoothed: each order falls back to the next shorter one, down to
the uniform distribution, and contexts that were never seen are passed over.  A
URL's score is the difference of the two log-likelihoods over its length;
scores at or over a threshold are blocked.

What is learnt from.  URLs that a rule allows are accepted; those whose host
holds a word of ``REJECTED`` and that no rule allows are rejected.  The models never see what the rules look at: the last label of
the host, labels that rules name, and as much of the path as the longest rule
reaches are cut off, in learning and in scoring (``bare``).  What is left of a
URL that a rule blocks is therefore like any other, and teaches nothing; it is learnt
from only where no words are given.

Plan.  Texts are made distinct, with how often each was accepted and rejected.
Their (ORDER + 1)-grams are counted in the tasks and summed by a shuffle; their
number grows with the input.  Grams that share the last ``LOW`` + 1 characters
before the one to be told come to one task, which takes all longer orders of
them at once; shorter orders are tables, bounded by the alphabet alone, that the
driver makes from sums and broadcasts.  Each distinct gram has then one value,
and texts find theirs by a join.

Calibration.  Each half of the texts (by a hash of their hosts, so that no host
is in both) is also scored by the models of the other half.  The threshold is
made for the URLs that neither a rule nor a word judges, of which no model has
learnt anything: of all that block at most ``MOST_FALSE`` of those, the one with
the best balanced accuracy against rejected URLs, as the models score them that
never saw their hosts.  (Without such URLs the accepted ones take their place, scored in
the same way.)  Where none rejects a larger share of the rejected than of the
others, the models know nothing and block nothing.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule, and is scored as the text it is (null: empty); repeated rows count each;
of two rules of the same length that fit the one that sorts last wins; ties at
the threshold are blocked; where the rules leave no accepted or no rejected URL to learn from, all other
URLs are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textops
from ledgerloom.llm.common import ascii_lower, column, cut, free, fresh, mapped

#: The rules, (verdict, host and path).
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Words that mark a host as unwanted, to learn from; they give no verdict by themselves, and none where a rule does.
REJECTED = ("casino", "poker", "spam", "viagra", "pills", "porn", "xxx", "warez", "jackpot", "betting")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-./?=&#_%:"
#: Characters of context, and those of the contexts that are kept as tables.
ORDER, LOW = 6, 2
#: Share of the URLs that neither a rule nor a word judges that the threshold may block, at most.
MOST_FALSE = 0.01
BINS = 4000
SPAN = 8.0
#: Scores of distinct texts that go back to the pages as a broadcast, at most (16 bytes each).
BROADCAST_SCORES = 500_000

BITS = 6  # of a symbol in a gram; the last character has the lowest
_SIZE = len(SYMBOLS) + 3  # 0: before the start, 1: the end, 2: any other character
_CODE = np.full(256, 2, np.int64)
for _k, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _k + 3
    _CODE[ord(_c.upper())] = _k + 3
#: Of the counts of a gram: half 0 accepted and rejected, half 1 accepted and rejected.
_COUNTS = ("a0", "r0", "a1", "r1")
_VALUES = ("value", "value0", "value1")  # by all, and by the other half for texts of half 0 and 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a later, longer one wins
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def bare_host(host: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A host without its last label and what rules name before that."""
    labels = sorted({x for _, r in rules for x in r.split("/", 1)[0].split(".")[:-1]})
    name = F.regexp_replace(host, r"(\.|^)[^.]*$", "")
    return F.regexp_replace(name, r"((\.|^)(" + "|".join(map(re.escape, labels)) + "))+$", "") if labels else name


def bare(url: Column, host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """What is left of a URL without what rules look at; all of a text that is no URL."""
    starts = [r.split("/", 1)[1].split("/") for _, r in rules]  # whole segments, and the beginning of one more
    deep = max([len(x) - 1 for x in starts], default=0)
    reach = max([len(x[-1]) for x in starts if len(x) - 1 == deep], default=0)
    tail = F.regexp_replace(path, f"^(/[^/]*){{0,{deep}}}(/[^/]{{0,{reach}}})?", "")
    more = F.substr(url, F.instr(url, "://") + 3 + F.length(host) + F.length(path))
    return F.coalesce(F.when(url.contains("://"), F.concat(bare_host(host, rules), F.lit("/"), tail, more)).otherwise(url), F.lit(""))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-gram that ends at each character of each text, its end included, as one number; and the texts' n + 1 offsets."""
    raw, offsets = textops.buffers(texts)
    n = np.diff(offsets)
    gap = ORDER + 1  # starts and one end
    at = offsets + gap * np.arange(len(offsets))
    text = np.zeros(at[-1], np.int64)
    place = np.arange(len(raw)) + np.repeat(at[:-1] + ORDER - offsets[:-1], n)
    text[place] = _CODE[raw]
    text[at[1:] - 1] = 1
    gram = np.zeros(len(text), np.int64)
    for k in range(ORDER + 1):
        gram[ORDER:] = (gram[ORDER:] << BITS) + text[k : len(text) - ORDER + k]
    keep = np.ones(len(text), bool)
    keep[(at[:-1][:, None] + np.arange(ORDER)).reshape(-1)] = False
    return gram[keep], offsets + np.arange(len(offsets))


def counts(texts: DataFrame) -> DataFrame:
    """(gram, a0, r0, a1, r1) of all grams of the texts (text, half, accepted, rejected), with zeros for those that are only to be scored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, at = _grams(b.column(0))
            half, *n = (b.column(k).to_numpy() for k in (1, 2, 3))
            unique, inverse = np.unique(gram, return_inverse=True)
            sums = [np.bincount(inverse, np.repeat(x * (half == h), np.diff(at)), len(unique)).astype(np.int64) for h in (0, 1) for x in n]
            yield pa.RecordBatch.from_arrays([pa.array(unique), *map(pa.array, sums)], ["gram", *_COUNTS])

    made = mapped(texts.select("text", "half", "accepted", "rejected"), task, "gram long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return made.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _mixed(n: np.ndarray, by: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Witten-Bell: counts of distinct (context, character) pairs with the number of their context, and the shorter order's probabilities."""
    size = int(by.max(initial=-1)) + 1
    total, kinds = np.bincount(by, n, size)[by], np.bincount(by, n > 0, size)[by]
    return np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)


def low_orders(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(last | the LOW before it) by the number of the (LOW + 1)-gram, from the counts of such grams."""
    p = np.full(1 << BITS, 1 / (_SIZE - 1))
    for order in range(LOW + 1):
        size = 1 << BITS * (order + 1)
        seen = np.bincount(gram & (size - 1), n, size)
        p = _mixed(seen, np.arange(size) >> BITS, np.tile(p, size // len(p)))
    return p


def high_orders(gram: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """P(last | the ORDER before it) of each gram; gram has all that share its last LOW + 1 characters of context, each once."""
    p = low[gram & ((1 << BITS * (LOW + 1)) - 1)]
    for order in range(LOW + 1, ORDER + 1):
        key, place = np.unique(gram & ((1 << BITS * (order + 1)) - 1), return_inverse=True)
        lower = np.zeros(len(key))
        lower[place] = p  # equal keys have equal shorter ones
        p = _mixed(np.bincount(place, n, len(key)), np.unique(key >> BITS, return_inverse=True)[1], lower)[place]
    return p


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Runs of whole groups of the first column, by which the rows are sorted."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if not len(now[0]):
            continue
        held.append(now)
        other = np.flatnonzero(now[0] != now[0][-1])
        if len(other) or now[0][0] != held[0][0][0]:
            end = int(other[-1]) + 1 if len(other) else 0
            held[-1] = [c[:end] for c in now]
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [[c[end:] for c in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def values(grams: DataFrame) -> DataFrame:
    """(gram, value, value0, value1): the log-likelihood difference of each gram's last character."""
    short = F.col("gram").bitwiseAND(F.lit((1 << BITS * (LOW + 1)) - 1)).alias("gram")
    got = grams.groupBy(short).agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()
    place, n = got.column("gram").to_numpy(), {c: got.column(c).to_numpy().astype(float) for c in _COUNTS}
    # by all, by half 1 (for texts of half 0), by half 0; accepted and rejected
    sides = [[("a0", "a1"), ("r0", "r1")], [("a1",), ("r1",)], [("a0",), ("r0",)]]
    low = [[low_orders(place, sum(n[c] for c in side)) for side in pair] for pair in sides]
    shared = grams.sparkSession.sparkContext.broadcast(low)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, *c in _runs(batches):
            mine = dict(zip(_COUNTS, c, strict=True))
            logs = [[np.log(high_orders(gram, sum(mine[x] for x in side), t)) for side, t in zip(pair, tables, strict=True)] for pair, tables in zip(sides, shared.value, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(r - a) for a, r in logs)], ["gram", *_VALUES])

    context = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << BITS * (LOW + 1)) - 1)).alias("context")
    dealt = grams.select(context, "gram", *_COUNTS).repartition("context").sortWithinPartitions("context")
    return mapped(dealt, task, "gram long, " + ", ".join(f"{v} double" for v in _VALUES))


def scores(texts: DataFrame, by_gram: DataFrame) -> DataFrame:
    """(id, score, score0, score1) of the texts (id, text): means over their characters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, at = _grams(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), np.diff(at))), pa.array(gram)], ["id", "gram"])

    each = mapped(texts.select("id", "text"), task, "id long, gram long")
    return each.join(by_gram, "gram").groupBy("id").agg(*[F.avg(v).alias(v.replace("value", "score")) for v in _VALUES])


def taught(known: DataFrame, text: str, host: str, verdict: str, rules: tuple[tuple[str, str], ...] = RULES, words: tuple[str, ...] = REJECTED) -> DataFrame:
    """(id, text, half, accepted, rejected, open) of the distinct texts of URLs: how often each teaches either model, and how often none; halves share no host."""
    marked = F.lit(False)
    for word in words:
        marked = marked | F.col(host).contains(word)
    bad = F.when(F.col(verdict) == "allow", F.lit(False)).when(marked if words else F.col(verdict) == "block", F.lit(True))
    half = F.pmod(F.xxhash64(F.lit(5), bare_host(F.col(host), rules)), F.lit(2)).cast("long").alias("half")
    open_ = (F.col(verdict).isNull() & ~marked).alias("open")
    texts = known.select(F.col(text).alias("text"), half, bad.alias("bad"), open_).groupBy("text")
    texts = texts.agg(F.min("half").alias("half"), F.count_if(~F.col("bad")).alias("accepted"), F.count_if("bad").alias("rejected"), F.count_if("open").alias("open"))
    return texts.withColumn("id", F.xxhash64("text"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, words: tuple[str, ...] = REJECTED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and url_score, under names that pages does not have (see ``free``).

    Rows are joined with the scores of their texts, so columns that are not wanted should be left out before.
    """
    names = [free(pages, n) for n in ("host", "path", "rule", "verdict", "url_score")]
    key, score = fresh(pages, "text", "score")
    text = column(url).cast("string")
    host, path = host_and_path(text)
    known = pages.withColumn(names[0], host).withColumn(names[1], path)
    rule, verdict = rule_of(F.col(names[0]), F.col(names[1]), rules)
    known = known.withColumn(key, bare(text, F.col(names[0]), F.col(names[1]), rules)).withColumn(names[2], rule).withColumn(names[3], verdict)
    texts = cut(taught(known, key, names[0], names[3], rules, words))
    sums = texts.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not sums[0] or not sums[1]:
        return known.withColumn(names[3], F.coalesce(names[3], F.lit("allow"))).withColumn(names[4], F.lit(0.0)).drop(key)
    found = cut(scores(texts, cut(values(cut(counts(texts))))))
    threshold = _threshold(texts, found)
    scored = found.select(F.col("id").alias(score), F.col("score").alias(names[4]))
    few = found.limit(BROADCAST_SCORES + 1).count() <= BROADCAST_SCORES
    out = known.join(F.broadcast(scored) if few else scored, F.xxhash64(key) == F.col(score), "left")
    says = F.when(F.col(names[4]) >= threshold, "block").otherwise("allow")
    return out.withColumn(names[3], F.coalesce(names[3], says)).select(*[column(c) for c in pages.columns], *names)


def _threshold(texts: DataFrame, found: DataFrame) -> float:
    """The score with the best balanced accuracy: rejected texts by the other half's model, against those that no model has learnt from; infinite where none helps."""
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((c + SPAN) / (2 * SPAN) * BINS))).cast("int")
    held = place(F.when(F.col("half") == 0, F.col("score0")).otherwise(F.col("score1")))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), at.alias("bin"), F.col(n).alias("n")) for k, (at, n) in enumerate(((place(F.col("score")), "open"), (held, "rejected"), (held, "accepted")))])
    rows = texts.join(found, "id").select(F.explode(sides).alias("x")).select("x.*").where("n > 0").groupBy("side", "bin").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((3, BINS + 1))
    for r in rows:
        total[r["side"], r["bin"]] += r["n"]
    return best_threshold(total[:2] if total[0].any() else total[[2, 1]])


def best_threshold(total: np.ndarray) -> float:
    """The threshold by the numbers in each bin of URLs that it should spare, and of rejected ones."""
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(total, axis=1)], axis=1)[:, : BINS + 1] / np.maximum(total.sum(axis=1, keepdims=True), 1)
    gain = np.where(1 - below[0] <= MOST_FALSE, below[0] - below[1], -1.0)
    if gain.max() <= 1e-12:
        return math.inf
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)
