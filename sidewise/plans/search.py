"""Level-by-level search for accords.

Each level asks for the counts of a few sides of the new feature with pairs of core sides of the
surviving nodes. They are gathered over all nodes and counted by one aggregation (or none, where
few features let all triples be counted beforehand). The rest happens on the small tree.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from ..operators import counts
from .tree import AccordTree, Node, Side


class Order:
    """Whether an oriented side lies below another, from one contingency of all pairs; of real
    features, whether its values are nowhere above the other's."""

    def __init__(self, df: DataFrame, names: Sequence[str], real: bool = False) -> None:
        find = counts.comparable_values if real else counts.comparable
        rows = find(df, names).collect() if len(names) > 1 else []
        self.table = {((r["i"], r["oi"]), (r["j"], r["oj"])): r["le"] for r in rows}

    def __call__(self, a: Side, b: Side) -> bool:
        return a == b or self.table.get((a, b), False)


log = logging.getLogger("sidewise")


def log_progress(event: str, **what: object) -> None:
    """The default listener: writes events to the log at level INFO."""
    log.info("%s %s", event, what)


class Sweep:
    """Appends features to a tree, keeping nodes below the bound as leaves so that a search can
    be resumed with a lower one. ``count`` counts rows on sets of sides, in batches through
    ``count.many`` if it has that; ``below`` compares oriented sides."""

    def __init__(self, count: Callable[..., float], below: Callable[[Side, Side], bool], features: Sequence[int] = (), size: int = 3, progress: Callable[..., None] = log_progress) -> None:
        self.count, self.below, self.size, self.progress = count, below, size, progress
        self.tree = AccordTree(Node(count()), [])
        for f in features:
            self.append(f)

    @property
    def limit(self) -> float:
        return self.tree.limit()

    def _subsets(self, core: frozenset[Side], side: Side) -> list[frozenset[Side]]:
        return [frozenset((*c, side)) for k in range(self.size) for c in combinations(sorted(core), k)]

    def _forced(self, core: frozenset[Side], feature: int) -> int:
        """The side that a core side implies, or 0."""
        for s in (-1, 1):
            if any(self.below(c, (feature, s)) for c in core):
                return s
        return 0

    def _grow(self, nodes: list[Node], feature: int) -> list[Node]:
        """Children of nodes for one feature."""
        forced = [self._forced(n.core, feature) for n in nodes]
        wanted = [x for n, f in zip(nodes, forced, strict=True) if not f for s in (-1, 1) for x in self._subsets(n.core, (feature, s))]
        if hasattr(self.count, "many"):
            self.count.many(wanted)
        out = []
        for n, f in zip(nodes, forced, strict=True):
            if f:
                out.append(n.add(f, n.agreement, n.core))
                continue
            for s in (-1, 1):
                side = (feature, s)
                least = min(self.count(*x) for x in self._subsets(n.core, side))
                core = frozenset(c for c in n.core if not self.below(side, c)) | {side}
                out.append(n.add(s, min(n.agreement, least), core))
        return out

    def _extend(self, nodes: list[Node], level: int, bound: float) -> list[Node]:
        """Extend nodes of a level down to the last one, as far as they reach the bound."""
        for feature in self.tree.features[level:]:
            nodes = self._grow([n for n in nodes if n.agreement >= bound], feature)
        return nodes

    def append(self, feature: int, bound: float = 1) -> int:
        """Add a level; returns the number of its nodes from the bound on."""
        last = list(self.tree.levels())
        nodes = last[len(self.tree.features)] if len(last) > len(self.tree.features) else []
        self.tree.features.append(feature)
        made = self._grow([n for n in nodes if n.agreement >= bound], feature)
        self.progress("append", feature=feature, level=len(self.tree.features), nodes=len(made))
        return sum(n.agreement >= bound for n in made)

    def insert(self, at: int, feature: int, bound: float = 1) -> int:
        """Put a feature before level ``at``: what follows is searched again from there, so the
        tree equals one to which all were appended in this order. Counts are remembered."""
        levels = list(self.tree.levels(at))
        nodes = levels[at] if len(levels) > at else []
        for n in nodes:
            n.children.clear()
        self.tree.features.insert(at, feature)
        last = self._extend(nodes, at, bound)
        self.progress("insert", feature=feature, level=at, nodes=len(last))
        return sum(n.agreement >= bound for n in last)

    def sweep_below(self, agreement: float) -> float:
        """Extend every leaf from ``agreement`` on down to the last level; returns the new limit."""
        total = self.tree.number_of_features
        for level in range(total):
            nodes = next((x for k, x in enumerate(self.tree.levels(level)) if k == level), [])
            made = self._grow([n for n in nodes if not n.children and n.agreement >= agreement], self.tree.features[level])
            self.progress("sweep", level=level, agreement=agreement, nodes=len(made))
        return self.limit

    def sweep_one(self) -> float:
        return self.sweep_below(self.limit)

    def greedy(self, max_width: int, bound: float = 1, max_depth: int | None = None, start: Node | None = None) -> list[Node]:
        """At each level extend at most ``max_width`` leaves of the largest agreement."""
        nodes = [start or self.tree.root]
        first = nodes[0].level
        for feature in self.tree.features[first : None if max_depth is None else first + max_depth]:
            ready = sorted((n for n in nodes if n.agreement >= bound), key=lambda n: -n.agreement)[:max_width]
            nodes = [c for n in ready if n.children for c in n.children.values()] + self._grow([n for n in ready if not n.children], feature)
        return [n for n in nodes if n.agreement >= bound]


class Search:
    """A table of features and the search over it."""

    def __init__(self, df: DataFrame, names: Sequence[str], real: bool = False, size: int = 3) -> None:
        self.df, self.names = df, list(names)
        self.counter = counts.Counter(df, names, real)
        self.sweep = Sweep(self.counter, Order(df, names, real), size=size)

    @property
    def tree(self) -> AccordTree:
        return self.sweep.tree

    def matrix(self, agreement: float | None = None, **kw) -> np.ndarray:  # noqa: ANN003
        return self.tree.matrix(agreement, **kw)

    def lower_agreement(self, agreement: float) -> float:
        return self.sweep.sweep_below(agreement)

    def scores(self, agreement: float, normalize_rows: bool = True, normalize_cols: bool = False, id_col: str = "pid") -> DataFrame:
        from ..operators.analysis import accord_scores

        accords = self.tree.accords(self.df.sparkSession, agreement)
        return accord_scores(self.df, self.names, accords, normalize_rows, normalize_cols, id_col)


def search(
    df: DataFrame,
    names: Sequence[str],
    min_agreement: float,
    max_features: int | None = None,
    order: Callable[[DataFrame, Sequence[str]], DataFrame] | Sequence[int] | None = None,
    real: bool = False,
    size: int = 3,
) -> Search:
    """Rank the features (ascending order, or as listed), and append the first of them."""
    out = Search(df, names, real, size)
    if order is None:
        ranked = list(range(len(names)))
    elif callable(order):
        rows = order(df, names).collect()
        ranked = [r["feature"] for r in sorted(rows, key=lambda r: (r["value"], r["feature"]))]
    else:
        ranked = list(order)
    for f in ranked[:max_features]:
        if not out.sweep.append(f, min_agreement):
            break
    return out


def path_of(tree: AccordTree, matrix_row: Sequence[int]) -> Node:
    """The node of a row of the accord matrix."""
    return tree.by_path([int(s) for s in matrix_row if s])


def guided(tree: AccordTree, df: DataFrame, names: Sequence[str], subset_col: str, min_agreement: float = 1) -> Node:
    """Follow the majority of a subset of rows, up to the first tie, as far as the tree goes."""
    from pyspark.sql import functions as F

    sums = df.where(subset_col).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    path = []
    for f in tree.features:
        s = int(np.sign(sums[f"s{f}"]))
        if s == 0:
            break
        path.append(s)
    return tree.pruned(min_agreement).by_path(path)


def is_guiding(node: Node, df: DataFrame, names: Sequence[str], subset_col: str) -> bool:
    """Whether most rows of the subset are on each side of the node's core."""
    from pyspark.sql import functions as F

    core = sorted(node.core)
    if not core:
        return True
    shares = df.where(subset_col).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(names[f]) * s > 0).alias(f"c{k}") for k, (f, s) in enumerate(core)]
    ).first()
    return all(2 * shares[f"c{k}"] > shares["n"] for k in range(len(core)))


class Certificate:
    """Why no accord continues: for each leaf a set of at most ``size`` chosen sides with too
    few rows. Nodes whose feature no certificate needs can be removed."""

    def __init__(self, feature: int | None, reason: frozenset[Side] | None, children: dict[int, Certificate]) -> None:
        self.feature, self.reason, self.children = feature, reason, children

    @staticmethod
    def create(sweep: Sweep, agreement: float, allowed: Sequence[tuple[int, ...]] = ()) -> Certificate:
        """From a searched tree; paths in ``allowed`` may stay without a reason."""
        tree, free = sweep.tree, {tuple(p) for p in allowed}

        def build(n: Node) -> Certificate:
            level = n.level
            if n.agreement < agreement:
                chosen = [(tree.features[k], s) for k, s in enumerate(n.path)]
                new, old = chosen[-1], chosen[:-1]
                for k in range(sweep.size):
                    for c in combinations(old, k):
                        if sweep.count(*c, new) < agreement:
                            return Certificate(None, frozenset((*c, new)), {})
                raise ValueError(f"{n.path}: a forced side lies below the bound")
            if not n.children:
                if n.path in free or level == len(tree.features):
                    return Certificate(None, None, {})
                raise ValueError(f"{n.path}: can be continued")
            missing = [s for s in (-1, 1) if s not in n.children]
            children = {s: build(c) for s, c in n.children.items()}
            for s in missing:
                side = (tree.features[level], s)
                core = next((c for c in sorted(n.core) if sweep.count(c, side) < agreement), None)
                if core is None:
                    raise ValueError(f"{n.path}: a forced side lies below the bound")
                children[s] = Certificate(None, frozenset((core, side)), {})
            return Certificate(tree.features[level], None, children)

        return build(tree.root)

    def needs(self) -> frozenset[int]:
        """Features that reasons below refer to."""
        own = frozenset(f for f, _ in self.reason) if self.reason else frozenset()
        return own.union(*[c.needs() for c in self.children.values()])

    def irreducible(self) -> Certificate:
        """Without nodes to whose feature a branch below doesn't refer: that branch takes the
        node's place."""
        if not self.children:
            return self
        children = {s: c.irreducible() for s, c in self.children.items()}
        for c in children.values():
            if self.feature not in c.needs() and (c.children or c.reason):
                return c
        return Certificate(self.feature, None, children)

    def features(self) -> list[int | None]:
        """By levels; None for leaves."""
        out, level = [], [self]
        while level:
            out += [c.feature for c in level]
            level = [c.children[s] for c in level for s in (-1, 1) if s in c.children]
        return out


