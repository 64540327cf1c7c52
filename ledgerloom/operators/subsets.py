"""Sub-transactions of one transaction as lists: partitions, mappings, and a table function that gives them.

``balances`` counts and lists them by joins over a whole ledger.  Here one
transaction's coins are searched through by themselves, for the few of interest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.balances import DEPTH

Partition = tuple[tuple[int, ...], ...]
Mapping = tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]


def subset_sums(coins: list[int]) -> set[int]:
    """The sums of all non-empty subsets, without 0."""
    sums = {0}
    for c in coins:
        sums |= {s + c for s in sums}
    return sums - {0}


def ambiguous_subsets(ins: list[int], outs: list[int], depth: int = DEPTH) -> int:
    """The input subsets of at most depth coins, all of them excepted, that some outputs balance."""
    valid = subset_sums(outs)
    return sum(sum(c) in valid for n in range(1, min(depth, len(ins) - 1) + 1) for c in combinations(ins, n))


def partitions(coins: list[int], valid: set[int]) -> Iterator[Partition]:
    """Set partitions of the coins' places into blocks with valid sums; a block holds the least place that is left."""

    def split(left: tuple[int, ...]) -> Iterator[Partition]:
        if not left:
            yield ()
            return
        head, rest = left[0], left[1:]
        for n in range(len(rest) + 1):
            for others in combinations(rest, n):
                if coins[head] + sum(coins[i] for i in others) in valid:
                    remain = tuple(i for i in rest if i not in others)
                    for tail in split(remain):
                        yield ((head, *others), *tail)

    yield from split(tuple(range(len(coins))))


def mappings(ins: list[int], outs: list[int]) -> list[Mapping]:
    """All pairings of an input partition with an output partition, block by block of equal sums; none where totals differ."""
    if sum(ins) != sum(outs):
        return []
    valid = subset_sums(ins) & subset_sums(outs)
    by_sums: dict[tuple[int, ...], list[Partition]] = defaultdict(list)
    for p in partitions(outs, valid):
        by_sums[tuple(sorted(sum(outs[i] for i in b) for b in p))].append(p)
    found = set()
    for p in partitions(ins, valid):
        sums = [sum(ins[i] for i in b) for b in p]
        for q in by_sums.get(tuple(sorted(sums)), ()):
            for order in _bijections(sums, [sum(outs[i] for i in b) for b in q]):
                found.add(tuple(sorted((p[k], q[j]) for k, j in enumerate(order))))
    return sorted(found)


def _bijections(left: list[int], right: list[int]) -> Iterator[tuple[int, ...]]:
    """Places of right for each of left, such that sums are equal."""
    by: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for k, s in enumerate(left):
        by[s][0].append(k)
    for k, s in enumerate(right):
        by[s][1].append(k)
    groups = list(by.values())

    def fill(at: int, chosen: dict[int, int]) -> Iterator[tuple[int, ...]]:
        if at == len(groups):
            yield tuple(chosen[k] for k in range(len(left)))
            return
        mine, theirs = groups[at]
        for order in permutations(theirs):
            yield from fill(at + 1, chosen | dict(zip(mine, order, strict=True)))

    yield from fill(0, {})


def splittable(ins: list[int], outs: list[int], block: tuple[tuple[int, ...], tuple[int, ...]]) -> bool:
    """Whether some proper part of the block's inputs balances some proper part of its outputs."""
    a, b = block
    proper = lambda coins, places: {sum(coins[i] for i in c) for n in range(1, len(places)) for c in combinations(places, n)}
    return bool((proper(ins, a) & proper(outs, b)) - {0})


def non_derived(ins: list[int], outs: list[int]) -> list[Mapping]:
    """The mappings no block of which splits further."""
    return [m for m in mappings(ins, outs) if not any(splittable(ins, outs, b) for b in m)]


#: A block of a mapping: the mapping it is of (its blocks in order, as text), the places of its coins, and their amount.
BLOCK = T.StructType([T.StructField("tx_id", T.LongType()), T.StructField("mapping", T.StringType()), T.StructField("ins", T.StringType()), T.StructField("outs", T.StringType()), T.StructField("amount", T.LongType())])


class MappingBlocks:
    """A table function over coins (tx_id, side, place, v), PARTITION BY tx_id: side 0 spends, side 1 is made.

    It holds the coins of one transaction, and gives the blocks of each of its mappings.
    """

    def __init__(self) -> None:
        self.tx_id: int | None = None
        self.sides: tuple[list, list] = ([], [])

    def eval(self, row) -> None:  # noqa: ANN001
        self.tx_id = row["tx_id"]
        self.sides[row["side"]].append((row["place"], row["v"]))

    def terminate(self) -> Iterator[tuple]:
        ins, outs = (sorted(side) for side in self.sides)
        name = lambda side, block: ",".join(str(side[i][0]) for i in block)
        for mapping in mappings([v for _, v in ins], [v for _, v in outs]):
            blocks = [(name(ins, a), name(outs, b), sum(ins[i][1] for i in a)) for a, b in mapping]
            text = "".join(f"({a}>{b})" for a, b, _ in blocks)
            for a, b, amount in blocks:
                yield self.tx_id, text, a, b, amount


def register(spark: SparkSession) -> None:
    """Makes ``mapping_blocks`` known to SQL."""
    spark.udtf.register("mapping_blocks", F.udtf(MappingBlocks, returnType=BLOCK))


def mapping_blocks(coins: DataFrame) -> DataFrame:
    """The blocks of all mappings of coins (tx_id, side, place, v); ``SELECT .. FROM mapping_blocks(TABLE(..) PARTITION BY tx_id)`` in SQL."""
    rows = coins.select("tx_id", "side", "place", "v")
    return F.udtf(MappingBlocks, returnType=BLOCK)(rows.asTable().partitionBy("tx_id"))
