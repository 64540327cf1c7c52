"""Sub-transactions as joins: which inputs of a transaction balance which of its outputs.

A subset of a transaction's coins is a mask, a number with a bit for each coin.
Nothing enumerates whole sides: each is cut in two halves, and inputs and outputs
meet in the middle.  A subset a + b of the inputs (of either half) balances c + d
of the outputs where a - c = d - b, so the differences of both first halves are
joined with those of both second halves, by transaction and difference.  A
transaction of 24 coins is 4,096 rows on either side of that join, dealt over
all tasks by their differences.

Where only the sums of outputs matter, they are kept once each, and halves are
made by joining halves of halves, so that many equal amounts stay few.  Counts
go on from there in rounds: a round takes from what is left of a transaction
each block that holds the first coin left, and adds up the ways to get to the
same rest.  Rounds are at most as many as the coins of the smaller side.

The number of blocks can be exponential in the number of coins, and so then is the
number of rows; no bound cuts them off.  A side of more than 62 coins does not
fit a mask, and a count may not fit 64 bits: those results are null (sums and
ambiguous subsets need no masks).  Coins of value 0 get the last bits, so that the first coin left is
never one unless all are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut, stored
from ledgerloom.functions import scalars
from ledgerloom.ledger import Ledger

DEPTH = 8  # coins of an input subset that is held ambiguous, at most
#: Coins that a mask holds.
MOST = 62
SALTS = 4
#: Coins of a side whose subsets are gone through in a row, at most: 256 sums.
SMALL = 8
#: Coins of a side whose different sums are made in a row, at most (65,536 sums), and inputs whose subsets are gone through there (4,096).
SUMMED, TAKEN = 16, 12
#: Bits of a mask that a task counts through by itself.
LOW_BITS = 10
WAYS = "decimal(38,0)"


def coins(ledger: Ledger, even: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tx_id, k, v, n, place) of the inputs that are resolved and of the outputs, of transactions that have both; k from 0.

    even: of those alone whose sides add up to the same, as no others have mappings.
    """
    ins = ledger.spent.where("prev_value IS NOT NULL").select("tx_id", F.col("vin").alias("place"), F.col("prev_value").alias("v"))
    outs = ledger.txout.select("tx_id", F.col("vout").alias("place"), F.col("value").alias("v"))
    if even:
        ins, _ = stored(ins)
        ids = cut(_even(ins, outs))
    else:
        ids = cut(ins.select("tx_id").distinct().join(outs.select("tx_id").distinct(), "tx_id"))

    def numbered(side: DataFrame) -> DataFrame:
        own = Window.partitionBy("tx_id")
        k = F.row_number().over(own.orderBy(F.col("v") == 0, "place")) - 1
        return cut(side.join(ids, "tx_id", "left_semi").select("tx_id", k.alias("k"), F.col("v").cast("long").alias("v"), F.count(F.lit(1)).over(own).cast("int").alias("n"), "place"))

    return numbered(ins), numbered(outs)


def _even(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """(tx_id) of the transactions whose inputs and outputs add up to the same, more than nothing."""
    whole = lambda side: side.groupBy("tx_id").agg(F.sum("v").alias("s"))
    return whole(ins).where("s > 0").join(whole(outs), ["tx_id", "s"]).select("tx_id")


def _ids(side: DataFrame) -> DataFrame:
    return side.select("tx_id", "n").distinct()


def _masks(side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tx_id, mask, total) of all subsets of the first and of the second half of the coins, the empty one too."""
    second = (2 * F.col("k") >= F.col("n")).cast("int")
    listed = side.where(F.col("n") <= MOST).groupBy("tx_id", second.alias("half")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c"))
    both = _ids(side).where(F.col("n") <= MOST).select("tx_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    halves = both.join(listed, ["tx_id", "half"], "left").withColumn("c", F.coalesce("c", F.expr("cast(array() as array<struct<k: int, v: bigint>>)")))
    counted = lambda bits: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, cast({bits} as int)) - 1")))
    tops = halves.select("*", counted(f"greatest(size(c) - {LOW_BITS}, 0)").alias("top")).repartition("tx_id", "half", "top")
    rows = tops.select("*", counted(f"least(size(c), {LOW_BITS})").alias("low")).withColumn("m", F.expr(f"shiftleft(top, {LOW_BITS}) + low"))
    taken = "filter(transform(c, (x, i) -> IF(shiftright(m, i) & 1 = 1, x, NULL)), x -> x IS NOT NULL)"
    rows = rows.select("tx_id", "half", F.expr(f"aggregate({taken}, 0L, (a, x) -> a + shiftleft(1L, x.k))").alias("mask"), F.expr(f"aggregate({taken}, 0L, (a, x) -> a + x.v)").alias("total"))
    rows = cut(rows)
    return rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half")


def _salted(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A join whose left rows of one key go to ``SALTS`` tasks."""
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(*[c for c in left.columns if c not in by]), F.lit(SALTS)).cast("int")).join(spread, [*by, "salt"]).drop("salt")


def _sums(side: DataFrame, counted: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tx_id, total [, size, n]) of the different sums of the first and of the second half of the coins.

    counted: sums are told apart by their number of coins, so many at most, and n says how many subsets have them.
    """
    keys = ["size"] if counted is not None else []
    one = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("size")), F.struct(F.col("v").alias("total"), F.lit(1).alias("size")))).alias("x")
    now = side.select("tx_id", F.col("n").alias("blocks"), F.col("k").alias("block"), one).select("tx_id", "blocks", "block", "x.*", F.lit(1).cast(WAYS).alias("ways"))

    def merged(rows: DataFrame) -> DataFrame:
        by = rows.groupBy("tx_id", "blocks", "block", "total", *keys)
        return by.agg(F.sum("ways").cast(WAYS).alias("ways")) if keys else by.agg(F.max("ways").alias("ways"))

    now = cut(merged(now))
    while not now.where("blocks > 2").isEmpty():
        many = now.where("blocks > 2").withColumn("to", F.floor(F.col("block") / 2).cast("int"))
        ends = many.where("block % 2 = 0").select("tx_id", "blocks", "to", "total", *keys, "ways")
        other = many.where("block % 2 = 1").select("tx_id", "to", F.col("total").alias("more"), *[F.col(c).alias("size_more") for c in keys], F.col("ways").alias("ways_more"))
        pairs = _salted(ends, other, ["tx_id", "to"]).withColumn("total", F.col("total") + F.col("more")).withColumn("ways", (F.col("ways") * F.col("ways_more")).cast(WAYS))
        if keys:
            pairs = pairs.withColumn("size", F.col("size") + F.col("size_more")).where(F.col("size") <= counted)
        alone = ends.where("blocks % 2 = 1 AND to = (blocks - 1) / 2")
        new = pairs.select("tx_id", "blocks", "to", "total", *keys, "ways").union(alone.select("tx_id", "blocks", "to", "total", *keys, "ways")).withColumnRenamed("to", "block")
        new = new.withColumn("blocks", F.ceil(F.col("blocks") / 2).cast("int"))
        rest = now.where("blocks <= 2").select("tx_id", "blocks", "block", "total", *keys, "ways")
        now = cut(merged(new.select("tx_id", "blocks", "block", "total", *keys, "ways")).unionByName(rest))
    empty = _ids(side).where("n = 1").select("tx_id", F.lit(0).cast("long").alias("total"), *[F.lit(0).alias(c) for c in keys], F.lit(1).cast(WAYS).alias("ways"))
    half = lambda k: now.where(f"block = {k}").select("tx_id", "total", *keys, "ways")
    return half(0), half(1).unionByName(empty)


def _named(df: DataFrame, letter: str) -> DataFrame:
    return df.select("tx_id", *[F.col(c).alias(f"{letter}_{c}") for c in df.columns if c != "tx_id"])


def _balanced(ins: tuple[DataFrame, DataFrame], outs: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows of both halves of inputs (a_, b_) and of outputs (c_, d_) whose totals are equal and not 0."""
    (a, b), (c, d) = ins, outs
    left = _salted(_named(a, "a"), _named(c, "c"), ["tx_id"]).withColumn("apart", F.expr("a_total - c_total"))
    right = _salted(_named(b, "b"), _named(d, "d"), ["tx_id"]).withColumn("apart", F.expr("d_total - b_total"))
    return left.join(right, ["tx_id", "apart"]).where("a_total + b_total <> 0")


def sum_counts(ledger: Ledger) -> DataFrame:
    """(tx_id, n_sums): the number of different sums other than zero that outputs of each transaction have.

    Of transactions with ``SUMMED`` outputs at most they are made in a row, where all its coins are; of others by joins.
    """
    both, _ = stored(_amounts(ledger))
    is_small = F.size("o") <= SUMMED
    small = both.where(is_small).select("tx_id", F.size(F.expr(_sums_in_row("o"))).cast("long").alias("n_sums"))
    large = both.where(~is_small)
    return small if large.isEmpty() else small.unionByName(_sums_joined(_coins_of(large, "o")))


def _sums_joined(outs: DataFrame) -> DataFrame:
    """The same by joins, of coins (tx_id, k, v, n)."""
    first, second = _sums(outs)
    both = _salted(first.select("tx_id", "total"), second.select("tx_id", F.col("total").alias("more")), ["tx_id"]).select("tx_id", F.expr("total + more").alias("total"))
    return _told(outs, both.where("total <> 0").distinct().groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_sums")), "n_sums")


def _amounts(ledger: Ledger) -> DataFrame:
    """(tx_id, i, o): the amounts of a transaction's inputs that are resolved and of its outputs, in any order, of transactions that have both."""
    listed = lambda side, v, name: side.groupBy("tx_id").agg(F.collect_list(F.col(v).cast("long")).alias(name))
    ins = ledger.spent.where("prev_value IS NOT NULL").select("tx_id", "prev_value")
    return listed(ins, "prev_value", "i").join(listed(ledger.txout.select("tx_id", "value"), "value", "o"), "tx_id")


def _coins_of(both: DataFrame, side: str) -> DataFrame:
    """(tx_id, k, v, n) of one side of rows of ``_amounts``."""
    return cut(both.select("tx_id", F.posexplode(side).alias("k", "v"), F.size(side).alias("n")))


def _sums_in_row(side: str) -> str:
    """The different sums other than zero of a row's coins."""
    return f"filter(aggregate({side}, array(0L), (s, v) -> array_distinct(concat(s, transform(s, x -> x + v)))), x -> x <> 0)"


def _told(side: DataFrame, counts: DataFrame, name: str, masks: bool = False) -> DataFrame:
    """A count for each transaction: 0 where there is none, null beyond the bounds."""
    n = F.expr(f"try_cast(coalesce({name}, 0) as bigint)")
    known = _ids(side).join(counts, "tx_id", "left")
    return known.select("tx_id", (F.when(F.col("n") <= MOST, n) if masks else n).alias(name))


def ambiguous(ledger: Ledger, depth: int = DEPTH) -> DataFrame:
    """(tx_id, n_ambiguous): the input subsets of at most depth coins, all of them excepted, that some outputs balance.

    Those of transactions with ``TAKEN`` inputs and ``SUMMED`` outputs at most are gone through in a row; of others by joins.
    """
    both, _ = stored(_amounts(ledger))
    is_small = (F.size("i") <= TAKEN) & (F.size("o") <= SUMMED)
    small = both.where(is_small).select("tx_id", _ambiguous_in_row(depth).alias("n_ambiguous"))
    large = both.where(~is_small)
    return small if large.isEmpty() else small.unionByName(_ambiguous_joined(_coins_of(large, "i"), _coins_of(large, "o"), depth))


def _ambiguous_in_row(depth: int) -> Column:
    """The ambiguous subsets of a row's inputs (i) by its outputs (o): sums of inputs stand at the places of their masks, and only those that outputs have are looked for."""
    size = "cast(bit_count(m) as int)"
    subset = f"{size} BETWEEN 1 AND {depth} AND {size} < size(i) AND array_contains(e.met, t)"
    met = f"transform(array({_masked_sums('i')}), s -> named_struct('sums', s, 'met', array_intersect(s, {_sums_in_row('o')})))"
    return F.expr(f"transform({met}, e -> size(filter(e.sums, (t, m) -> {subset})))[0]").cast("long")


def _masked_sums(side: str) -> str:
    """The sums of all subsets of a row's coins, at the places of their masks."""
    return f"aggregate({side}, array(0L), (s, v) -> concat(s, transform(s, x -> x + v)))"


def _ambiguous_joined(ins: DataFrame, outs: DataFrame, depth: int) -> DataFrame:
    """The same by joins, of coins (tx_id, k, v, n)."""
    found = _balanced(_sums(ins, depth), tuple(x.select("tx_id", "total") for x in _sums(outs)))
    found = found.select("tx_id", "a_total", "a_size", "a_ways", "b_total", "b_size", "b_ways").distinct().join(_ids(ins), "tx_id")
    size = F.col("a_size") + F.col("b_size")
    some = found.where((size >= 1) & (size <= depth) & (size < F.col("n")))
    return _told(ins, some.groupBy("tx_id").agg(F.sum((F.col("a_ways") * F.col("b_ways")).cast(WAYS)).alias("n_ambiguous")), "n_ambiguous")


def partition_counts(ledger: Ledger) -> DataFrame:
    """(tx_id, n_partitions): the input partitions whose block sums are all sums of outputs.

    A transaction whose sides have ``SMALL`` coins at most is counted through in its row, where all its coins are; others by joins.
    """
    both, _ = stored(_gathered(ledger))
    small = both.where(_is_small()).select("tx_id", _counted_in_row().alias("n_partitions"))
    large = both.where(~_is_small())
    if large.isEmpty():
        return small
    one = lambda c: cut(large.select("tx_id", F.posexplode(c).alias("k", "v"), F.size(c).alias("n")))
    return small.unionByName(_partitions_joined(one("i"), one("o")))


def _gathered(ledger: Ledger) -> DataFrame:
    """(tx_id, i, o): the amounts of a transaction's inputs that are resolved and of its outputs, in the order of ``coins``, of transactions that have both."""

    def listed(side: DataFrame, place: str, v: str, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct((F.col(v) == 0).alias("zero"), F.col(place).alias("place"), F.col(v).cast("long").alias("v"))))
        return side.groupBy("tx_id").agg(pairs.getField("v").alias(name))

    ins = ledger.spent.where("prev_value IS NOT NULL").select("tx_id", "vin", "prev_value")
    return listed(ins, "vin", "prev_value", "i").join(listed(ledger.txout.select("tx_id", "vout", "value"), "vout", "value", "o"), "tx_id")


def _is_small() -> Column:
    return (F.size("i") <= SMALL) & (F.size("o") <= SMALL)


def _counted_in_row() -> Column:
    """The partitions of a row's inputs (i) into blocks whose sums are sums of its outputs (o).

    Sums stand at the places of their masks.  The ways to take a mask apart are made from the smallest mask on:
    those of each block in it that holds its first coin, by the ways of what it leaves.
    """
    full = "cast(shiftleft(1, size(i)) - 1 as int)"
    blocks = f"transform(array({_masked_sums('i')}), a -> transform(array({_masked_sums('o')}), b -> filter(sequence(1, {full}), m -> a[m] <> 0 AND array_contains(b, a[m])))[0])[0]"
    ways = "aggregate(filter(blocks, x -> x & m = x AND x & (m & -m) <> 0), 0L, (n, x) -> n + w[m - x])"
    return F.expr(f"transform(array({blocks}), blocks -> element_at(aggregate(sequence(1, {full}), array(1L), (w, m) -> concat(w, array({ways}))), -1))[0]")


def _partitions_joined(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """The same by joins, of coins (tx_id, k, v, n)."""
    found = _balanced(_masks(ins), tuple(x.select("tx_id", "total") for x in _sums(outs)))
    blocks = cut(found.select("tx_id", F.expr("a_mask + b_mask").alias("a")).distinct().withColumn("low", F.expr("a & -a")))
    now = _ids(ins).where(F.col("n") <= MOST).select("tx_id", F.expr("shiftleft(1L, n) - 1").alias("ra"), F.lit(1).cast(WAYS).alias("ways"))
    return _told(ins, _ways(now, blocks, ["a"], "n_partitions"), "n_partitions", masks=True)


def _ways(now: DataFrame, blocks: DataFrame, sides: list[str], name: str) -> DataFrame:
    """(tx_id, name): how often all that is left (ra [, rb]) can be taken apart by blocks (low, a [, b]) that each hold the first coin left."""
    rests = [f"r{s}" for s in sides]
    done = None
    now = cut(now)
    while not now.isEmpty():
        steps = now.withColumn("low", F.expr("ra & -ra")).join(blocks, ["tx_id", "low"]).where(" AND ".join(f"r{s} & {s} = {s}" for s in sides))
        left = steps.select("tx_id", *[F.expr(f"r{s} - {s}").alias(f"r{s}") for s in sides], "ways").groupBy("tx_id", *rests).agg(F.sum("ways").cast(WAYS).alias("ways"))
        left = cut(left)
        ended = left.where(" AND ".join(f"{r} = 0" for r in rests)).select("tx_id", "ways")
        done = ended if done is None else done.union(ended)
        now = left.where("ra <> 0")
    none = now.select("tx_id", "ways")
    return (none if done is None else done).groupBy("tx_id").agg(F.sum("ways").cast(WAYS).alias(name))


def _pairs(ins: DataFrame, outs: DataFrame, derived: bool) -> DataFrame:
    """(tx_id, low, a, b): masks of inputs and outputs of equal sums, of transactions whose sides are equal; unless derived, those that hold no other one."""
    even = cut(_even(ins, outs))
    some = lambda side: side.join(even, "tx_id", "left_semi")
    found = _balanced(_masks(some(ins)), _masks(some(outs)))
    pairs = cut(found.select("tx_id", F.expr("a_mask + b_mask").alias("a"), F.expr("c_mask + d_mask").alias("b")).withColumn("low", F.expr("a & -a")))
    if derived:
        return pairs
    # of two parts of a pair one holds its first input, so that only such parts have to be looked for
    inner = pairs.select("tx_id", "low", F.col("a").alias("x"), F.col("b").alias("y"))
    on = (F.col("p.tx_id") == F.col("q.tx_id")) & (F.col("p.low") == F.col("q.low"))
    inside = on & F.expr("x & a = x AND x <> a AND y & b = y AND y <> b")
    return cut(pairs.alias("p").join(inner.alias("q"), inside, "left_anti"))


def mapping_counts(ledger: Ledger, derived: bool) -> DataFrame:
    """(tx_id, n_mappings): the partitions of inputs and outputs into blocks of equal sums; those with blocks that split further too if derived."""
    ins, outs = coins(ledger)
    pairs = _pairs(ins, outs, derived)
    both = _ids(ins).join(_ids(outs).select("tx_id", F.col("n").alias("n_out")), "tx_id")
    now = both.where((F.col("n") <= MOST) & (F.col("n_out") <= MOST)).join(pairs.select("tx_id").distinct(), "tx_id", "left_semi")
    now = now.select("tx_id", F.expr("shiftleft(1L, n) - 1").alias("ra"), F.expr("shiftleft(1L, n_out) - 1").alias("rb"), F.lit(1).cast(WAYS).alias("ways"))
    most = both.select("tx_id", F.greatest("n", "n_out").alias("n"))
    return _told(most, _ways(now, pairs, ["a", "b"], "n_mappings"), "n_mappings", masks=True)


def mapping_lists(ledger: Ledger, derived: bool) -> DataFrame:
    """(tx_id, mapping): a row for each mapping, its blocks (ins, outs, amount) as places of the coins, in the order of their first inputs."""
    ins, outs = coins(ledger, even=True)
    pairs = _pairs(ins, outs, derived)
    full = lambda side, r: _ids(side).select("tx_id", F.expr("shiftleft(1L, n) - 1").alias(r))
    now = cut(full(ins, "ra").join(full(outs, "rb"), "tx_id").join(pairs.select("tx_id").distinct(), "tx_id", "left_semi").withColumn("blocks", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)")))
    done = now.select("tx_id", "blocks").limit(0)
    while not now.isEmpty():
        steps = now.withColumn("low", F.expr("ra & -ra")).join(pairs, ["tx_id", "low"]).where("ra & a = a AND rb & b = b")
        now = cut(steps.select("tx_id", F.expr("ra - a").alias("ra"), F.expr("rb - b").alias("rb"), F.concat("blocks", F.array(F.struct("a", "b"))).alias("blocks")))
        done = done.union(now.where("ra = 0 AND rb = 0").select("tx_id", "blocks"))
        now = now.where("ra <> 0")
    listed = lambda side, name: side.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("k", "place", "v"))).alias(name))
    placed = done.join(listed(ins, "i"), "tx_id").join(listed(outs, "o"), "tx_id")
    taken = lambda c, m: f"filter({c}, x -> shiftright({m}, x.k) & 1 = 1)"
    places = lambda c, m: f"array_sort(transform({taken(c, m)}, x -> cast(x.place as int)))"
    block = f"struct({places('i', 'y.a')} as ins, {places('o', 'y.b')} as outs, aggregate({taken('i', 'y.a')}, 0L, (s, x) -> s + x.v) as amount)"
    return placed.select("tx_id", F.expr(f"array_sort(transform(blocks, y -> {block}))").alias("mapping"))


#: A metric: the cost of n ambiguous subsets, of a budget.
Metric = Callable[[Column, Column], Column]


def privacy(ledger: Ledger, metrics: tuple[Metric, ...] = (scalars.subset_cost,), budget: float = 1.0, depth: int = DEPTH) -> DataFrame:
    """(tx_id, cost): what the metrics add up to for each transaction; others than the given one may take their places."""
    n, most = F.col("n_ambiguous"), F.lit(budget)
    return ambiguous(ledger, depth).select("tx_id", reduce(Column.__add__, [m(n, most) for m in metrics]).alias("cost"))
