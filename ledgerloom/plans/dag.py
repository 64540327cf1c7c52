"""Composable expressions over a ledger, lazy and possibly cyclic.

An expression is a node with dependencies and a function from their DataFrames
to its own.  Nothing runs until ``Engine.eval``; then the nodes that the asked
one needs are put together into one plan for Catalyst.  A cycle goes through a
``Placeholder``: its value starts as the default of its kind and the plan is
evaluated again and again, each time with the last value, until the value is
the same twice.  Only that comparison runs jobs in between.

    context = Context()
    txs = context.all_txs()
    change = txs.outputs().mask(naive_change)
    clusters = Placeholder(context, Clustering)
    gated = change.filtered_by(is_unilateral(txs, clusters.expr))
    clusters.unify(multi_input(txs).join(change_clusters(gated)))
    Engine(ledger).eval(clusters.expr)

Growing ledgers.  ``Engine.advance`` evaluates an expression for the
transactions that came since it was last asked about, and keeps the result as
one more fact of it; ``value`` is what all its facts add up to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut, removed, stored
from ledgerloom.ledger import Ledger
from ledgerloom.operators import clustering, masks, navigation
from ledgerloom.plans import facts

MAX_ROUNDS = 100
Make = Callable[..., DataFrame]


class CycleError(RuntimeError):
    """A cycle without a placeholder, or one that finds no fixpoint."""


@dataclass
class Node:
    id: int
    name: str
    kind: type[Expr]
    deps: list[Node]
    make: Make  # (ledger, *dependencies' frames)
    target: Node | None = None  # of a placeholder
    source: bool = False
    edges: Make | None = None  # of a clustering: the edges that it is the closure of, from the same


@dataclass
class Context:
    """The nodes made so far, and the user's own operations."""

    nodes: list[Node] = field(default_factory=list)
    _ids: count = field(default_factory=count)

    def register(self, kind: type[Expr], name: str, deps: list[Expr], make: Make) -> Expr:
        """A node of any function; ``kind`` says what its frame is."""
        node = Node(next(self._ids), name, kind, [d.node for d in deps], make)
        self.nodes.append(node)
        return kind(self, node)

    def source(self, kind: type[Expr], name: str, make: Callable[[Ledger], DataFrame]) -> Expr:
        """A node without dependencies; of its frame's transactions (tx_id) ``Engine.advance`` sees the new ones."""
        expr = self.register(kind, name, [], make)
        expr.node.source = True
        return expr

    def all_txs(self) -> TxSet:
        return self.source(TxSet, "all_txs", lambda g: g.tx.select("tx_id"))

    def dense_txs(self) -> TxSet:
        return self.source(TxSet, "dense_txs", lambda g: navigation.dense_txs(g.tx))

    def loose_txs(self) -> TxSet:
        return self.source(TxSet, "loose_txs", lambda g: navigation.loose_txs(g.tx))

    def __len__(self) -> int:
        return len(self.nodes)

    def __contains__(self, id: int) -> bool:
        return any(n.id == id for n in self.nodes)

    def names(self) -> dict[int, str]:
        return {n.id: n.name for n in self.nodes}


@dataclass(frozen=True)
class Expr:
    """A node with a kind: the schema of its frames, and how several facts are put together (bags by default).

    A kind of one's own is a subclass.
    """

    context: Context
    node: Node
    SCHEMA = ""
    KEY = ""
    combine = staticmethod(facts.combine_sets)

    def apply(self, kind: type[Expr], name: str, make: Make, *others: Expr) -> Expr:
        """A user's operation on this and other expressions."""
        return self.context.register(kind, name, [self, *others], make)

    def _closure(self, name: str, edges: Make) -> Clustering:
        """The clustering of edges that are made of this one."""
        expr = self.apply(Clustering, name, lambda g, x: clustering.cluster(edges(g, x)))
        expr.node.edges = edges
        return expr


class _Set(Expr):
    def filter(self, predicate: Callable[[Ledger], DataFrame] | Column) -> _Set:
        """Items for which the predicate holds: a column of the item's table, or a function from the ledger to a mask."""
        if isinstance(predicate, Column):
            table, key = self._table, self.KEY
            return self.apply(type(self), "filter", lambda g, x: x.join(table(g).where(predicate).select(key), key, "left_semi"))
        return self.apply(type(self), "filter", lambda g, x: masks.keep(x, predicate(g), self.KEY))

    def filter_with_mask(self, mask: Mask) -> _Set:
        return self.apply(type(self), "filter_with_mask", lambda g, x, m: masks.keep(x, m, self.KEY), mask)

    def exclude(self, mask: Mask) -> _Set:
        return self.apply(type(self), "exclude", lambda g, x, m: masks.exclude(x, m, self.KEY), mask)

    def mask(self, heuristic: Callable[[Ledger], DataFrame], whole: bool | None = None) -> Mask:
        """The heuristic's mask for the items of this set.

        Of transactions it is given those of the set alone, with what they spend, so that new ones cost
        no more than they are; one that looks at others needs the ``whole`` ledger.  Of outputs it always gets that.
        """
        key = self.KEY

        def make(g: Ledger, x: DataFrame) -> DataFrame:
            some = g if whole or (whole is None and key != "tx_id") else g.near(x)
            return heuristic(some).join(x.select(F.col(key).alias("key")).distinct(), "key", "left_semi")

        return self.apply(Mask, getattr(heuristic, "__name__", "mask"), make)


    def union(self, other: _Set) -> _Set:
        """Both bags, one after the other."""
        return self.apply(type(self), "union", lambda g, a, b: navigation.union(a, b), other)

    def intersect(self, other: _Set) -> _Set:
        key = self.KEY
        return self.apply(type(self), "intersect", lambda g, a, b: navigation.intersect(a, b, key), other)

    def subtract(self, other: _Set) -> _Set:
        key = self.KEY
        return self.apply(type(self), "subtract", lambda g, a, b: navigation.subtract(a, b, key), other)


class TxSet(_Set):
    SCHEMA, KEY = "tx_id long", "tx_id"
    _table = staticmethod(lambda g: g.tx)

    def outputs(self) -> TxOutSet:
        return self.apply(TxOutSet, "outputs", lambda g, x: navigation.outputs_of(x, g).select("out_id"))

    def multi_input(self) -> Clustering:
        return self._closure("multi_input", lambda g, x: clustering.multi_input_edges(g, x))

    def unilateral(self, clusters: Clustering) -> Mask:
        key = F.col("tx_id").alias("key")
        return self.apply(Mask, "unilateral", lambda g, x, c: clustering.is_unilateral(g, c).join(x.select(key).distinct(), "key", "left_semi"), clusters)


class TxOutSet(_Set):
    SCHEMA, KEY = "out_id long", "out_id"
    _table = staticmethod(lambda g: g.txout)

    def txs(self) -> TxSet:
        return self.apply(TxSet, "txs", lambda g, x: navigation.txs_of(x, g))

    def same_script(self) -> Clustering:
        return self.apply(Clustering, "same_script", lambda g, x: clustering.same_script(g, x))


class Mask(Expr):
    SCHEMA = "key long, flag boolean"
    combine = staticmethod(facts.combine_masks)

    def negate(self) -> Mask:
        return self.apply(Mask, "negate", lambda g, m: masks.negate(m))

    def __and__(self, other: Mask) -> Mask:
        return self.apply(Mask, "and", lambda g, a, b: masks.both(a, b), other)

    def __or__(self, other: Mask) -> Mask:
        return self.apply(Mask, "or", lambda g, a, b: masks.either(a, b), other)

    __invert__ = negate

    def on_outputs(self) -> Mask:
        """A mask of transactions as one of their outputs."""
        return self.apply(Mask, "on_outputs", lambda g, m: m.join(g.txout.select(F.col("tx_id").alias("key"), "out_id"), "key").select(F.col("out_id").alias("key"), "flag"))

    def change_clusters(self) -> Clustering:
        """Change outputs with what their transaction's first input spends."""
        return self._closure("change_clusters", lambda g, m: clustering.change_edges(g, m))


class Clustering(Expr):
    SCHEMA = "member long, cluster_id long"
    combine = staticmethod(facts.combine_clusterings)

    def join(self, other: Clustering) -> Clustering:
        """The finest clustering that both refine; one that is of edges is not clustered by itself before."""
        if edges := other.node.edges:
            known = [Expr(self.context, d) for d in other.node.deps]
            return self.apply(Clustering, "join", lambda g, a, *x: clustering.grown(stored(a)[0], stored(edges(g, *x))[0]), *known)
        return self.apply(Clustering, "join", lambda g, a, b: clustering.join(a, b), other)


class Placeholder:
    """A node that is bound later, to an expression that may depend on it."""

    def __init__(self, context: Context, kind: type[Expr]) -> None:
        self.expr = context.register(kind, "placeholder", [], lambda g: None)

    def unify(self, expr: Expr) -> None:
        if self.is_unified:
            raise ValueError("placeholder is unified already")
        if expr.node.kind is not self.expr.node.kind:
            raise TypeError(f"placeholder is a {self.expr.node.kind.__name__}")
        self.expr.node.target = expr.node

    @property
    def is_unified(self) -> bool:
        return self.expr.node.target is not None


class NoFacts(LookupError):
    """Nothing is known of a node yet."""


class Engine:
    def __init__(self, ledger: Ledger) -> None:
        self.ledger = ledger
        self.rounds = 0  # of the last evaluation
        self._facts: dict[int, list[DataFrame]] = {}
        self._base: dict[int, DataFrame] = {}
        self._cursors: dict[int, tuple[int, int]] = {}  # of each asked node: the next confirmed id, the last unconfirmed one
        self._window: tuple[int, int] | None = None  # the cursor that sources begin from, while a fact is made

    # a ledger that grows

    def extend(self, ledger: Ledger) -> None:
        """The ledger as it is now, with all that it had before; what changes is seen by the next ``advance``."""
        self.ledger = ledger

    def advance(self, expr: Expr) -> DataFrame | None:
        """The expression for the transactions that came since its last fact, as a new fact; None where none came.

        Only what sources give is new; what an operation looks up in the ledger
        (a spent output, say) is found wherever it stands.
        """
        dense, loose = self._cursors.get(expr.node.id, (0, 0))
        ends = self.ledger.tx.agg(F.max(F.when(F.col("tx_id") >= 0, F.col("tx_id"))), F.min(F.when(F.col("tx_id") < 0, F.col("tx_id")))).first()
        now = (dense if ends[0] is None else max(dense, ends[0] + 1), loose if ends[1] is None else min(loose, ends[1]))
        if now == (dense, loose):
            return None
        self._window = (dense, loose)
        try:
            fact = cut(self.eval(expr))
        finally:
            self._window = None
        self._facts.setdefault(expr.node.id, []).append(fact)
        self._cursors[expr.node.id] = now
        return fact

    def evaluated_facts(self, expr: Expr) -> list[DataFrame]:
        """The base of the expression, if one is set, and its facts, oldest first."""
        base = self._base.get(expr.node.id)
        return [*([base] if base is not None else []), *self._facts.get(expr.node.id, [])]

    def get(self, expr: Expr) -> DataFrame:
        """What the facts add up to; raises where there are none."""
        found = self.evaluated_facts(expr)
        if not found:
            raise NoFacts(expr.node.name)
        return found[0] if len(found) == 1 else expr.node.kind.combine(found)

    def get_or_default(self, expr: Expr) -> DataFrame:
        """The same, or an empty frame of the expression's kind."""
        return self.get(expr) if self.evaluated_facts(expr) else self._default(expr.node)

    def value(self, expr: Expr) -> DataFrame:
        """The facts up to now, those of transactions that came since the last one too."""
        self.advance(expr)
        return self.get_or_default(expr)

    def set_base(self, expr: Expr, frame: DataFrame) -> None:
        """A fact from elsewhere that stands before all others."""
        self._base[expr.node.id] = frame

    def take_base(self, expr: Expr) -> DataFrame | None:
        return self._base.pop(expr.node.id, None)

    # evaluation

    def eval(self, expr: Expr) -> DataFrame:
        """The expression's frame: a plan, or after a cycle's last round its checkpoint."""
        cyclic = self._placeholders(expr.node)
        values = {n.id: self._default(n) for n in cyclic}
        free = self._free(cyclic)
        fixed: dict[int, DataFrame] = {}  # frames of nodes that need no placeholder: the same in all rounds
        for node in self._borders(cyclic, free):
            fixed[node.id] = stored(self._frame(node, fixed))[0] if node.deps else self._frame(node, fixed)
        prints = {k: self._print(v) for k, v in values.items()}
        paths: list[str] = []  # of the last round's values
        self.rounds = 0
        while any(n.target for n in cyclic):
            if self.rounds == MAX_ROUNDS:
                raise CycleError(f"no fixpoint after {MAX_ROUNDS} rounds")
            self.rounds += 1
            frames: dict[int, DataFrame] = {**fixed, **values}
            new = {n.id: stored(self._frame(n.target, frames)) for n in cyclic if n.target}
            values |= {k: frame for k, (frame, _) in new.items()}
            for path in paths:
                removed(self.ledger.tx.sparkSession, path)
            paths = [path for _, path in new.values()]
            before, prints = prints, {k: self._print(v) for k, v in values.items()}
            if before == prints:
                break
        return self._frame(expr.node, {**fixed, **values})

    @staticmethod
    def _borders(cyclic: list[Node], free: set[int]) -> list[Node]:
        """The free nodes that others look at directly, which each round reads again."""
        seen, found, todo = set(), {}, [n.target for n in cyclic if n.target]
        while todo:
            n = todo.pop()
            if n.id in seen:
                continue
            seen.add(n.id)
            if n.id in free:
                found[n.id] = n
            else:
                todo += n.deps
        return [found[k] for k in sorted(found)]

    def _free(self, cyclic: list[Node]) -> set[int]:
        """The nodes below the placeholders' targets that need no placeholder themselves."""
        free, bound = set(), set()

        def look(n: Node) -> bool:
            if n.id not in free and n.id not in bound:
                needs = n.name == "placeholder" or not all([look(d) for d in n.deps])
                (bound if needs else free).add(n.id)
            return n.id in free

        for n in cyclic:
            if n.target:
                look(n.target)
        return free

    def _default(self, node: Node) -> DataFrame:
        return self.ledger.tx.sparkSession.createDataFrame([], node.kind.SCHEMA)

    def _placeholders(self, node: Node) -> list[Node]:
        """All placeholders that the node needs, in order of their ids."""
        seen, found, todo = set(), {}, [node]
        while todo:
            n = todo.pop()
            if n.id in seen:
                continue
            seen.add(n.id)
            if n.name == "placeholder":
                found[n.id] = n
                todo += [n.target] if n.target else []
            todo += n.deps
        return [found[k] for k in sorted(found)]

    def _frame(self, node: Node, frames: dict[int, DataFrame]) -> DataFrame:
        """The node's frame; equal nodes are put together once."""
        if node.id not in frames:
            frame = node.make(self.ledger, *[self._frame(d, frames) for d in node.deps])
            if self._window and node.source and "tx_id" in frame.columns:
                dense, loose = self._window
                frame = frame.where((F.col("tx_id") >= dense) | (F.col("tx_id") < loose))
            frames[node.id] = frame
        return frames[node.id]

    @staticmethod
    def _print(df: DataFrame) -> tuple:
        """A frame's number of rows and sum of their hashes, by which frames of the same rows are known."""
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
