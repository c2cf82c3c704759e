"""The search tree of accords and what is read from it.

An accord chooses a side of each feature, level by level, so that any three chosen sides share
enough rows; a node holds the least such number on its path (``agreement``) and the minimal
sides that imply the others (``core``). Level k of the tree decides the k-th feature. The tree
is small and lives on the driver; its readers are tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Side = tuple[int, int]


@dataclass(eq=False)
class Node:
    agreement: float
    core: frozenset[Side] = frozenset()
    parent: Node | None = None
    side: int = 0
    children: dict[int, Node] = field(default_factory=dict)

    @property
    def left(self) -> Node | None:
        return self.children.get(-1)

    @property
    def right(self) -> Node | None:
        return self.children.get(1)

    @property
    def path(self) -> tuple[int, ...]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.side)
            node = node.parent
        return tuple(reversed(out))

    @property
    def level(self) -> int:
        n, node = 0, self
        while node.parent is not None:
            n, node = n + 1, node.parent
        return n

    def add(self, side: int, agreement: float, core: frozenset[Side]) -> Node:
        self.children[side] = child = Node(agreement, core, self, side)
        return child

    def walk(self) -> Iterator[Node]:
        """This node and all below, by levels."""
        level = [self]
        while level:
            yield from level
            level = [n.children[s] for n in level for s in (-1, 1) if s in n.children]

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]

    def detach(self) -> Node:
        if self.parent is not None:
            del self.parent.children[self.side]
        self.parent, self.side = None, 0
        return self

    def copy(self, keep: Callable[[Node], bool] = lambda n: True) -> Node:
        """A copy of the part below, without nodes that fail ``keep`` and what hangs on them."""
        top = Node(self.agreement, self.core)
        todo = [(self, top)]
        while todo:
            old, new = todo.pop()
            for s, child in old.children.items():
                if keep(child):
                    todo.append((child, new.add(s, child.agreement, child.core)))
        return top

    def without_single_parents(self) -> Node:
        """A copy in which every inner node has two children."""
        node = self
        while len(node.children) == 1:
            node = next(iter(node.children.values()))
        top = Node(node.agreement, node.core)
        for s, child in node.children.items():
            part = child.without_single_parents()
            part.parent, part.side = top, s
            top.children[s] = part
        return top

    @staticmethod
    def from_paths(paths: np.ndarray) -> Node:
        """A tree with a node for each row of -1/0/+1; zeros end a path."""
        top = Node(0)
        for row in paths:
            node = top
            for s in row:
                if s == 0:
                    break
                node = node.children.get(int(s)) or node.add(int(s), 0, frozenset())
        return top


def padded(nodes: list[Node], width: int) -> np.ndarray:
    out = np.zeros((len(nodes), width), np.int8)
    for k, n in enumerate(nodes):
        path = n.path[:width]
        out[k, : len(path)] = path
    return out


class AccordTree:
    """Root, and the feature of each level."""

    def __init__(self, root: Node, features: list[int]) -> None:
        self.root, self.features = root, list(features)

    # -- sizes and limits -------------------------------------------------------------------
    @property
    def number_of_features(self) -> int:
        return len(self.features)

    def levels(self, max_level: int | None = None) -> Iterator[list[Node]]:
        level, k = [self.root], 0
        while level and (max_level is None or k <= max_level):
            yield level
            level = [n.children[s] for n in level for s in (-1, 1) if s in n.children]
            k += 1

    def level_sizes(self, agreement: float) -> list[int]:
        """Nodes of each level from ``agreement`` on."""
        return [sum(n.agreement >= agreement for n in level) for level in self.levels()]

    def height(self, agreement: float) -> int:
        """The deepest level with a node from ``agreement`` on; 0 if there is none."""
        sizes = self.level_sizes(agreement)
        return max((k for k, n in enumerate(sizes) if n), default=0)

    def limit(self) -> float:
        """The largest agreement of a node above the last level that wasn't extended: below and
        at it the tree may be incomplete."""
        last = self.number_of_features
        return max((n.agreement for k, level in enumerate(self.levels()) if k < last for n in level if not n.children), default=0)

    # -- readers ----------------------------------------------------------------------------
    def maximal(self, agreement: float, max_level: int | None = None, include_splitting: str = "no") -> list[Node]:
        """Nodes from ``agreement`` on that no child continues, from the top down. With "nodes"
        also those with two such children; with "levels" every node of a level on which some node
        has none or two."""
        if include_splitting not in ("no", "nodes", "levels"):
            raise ValueError(include_splitting)
        out: list[Node] = []
        depth = self.number_of_features if max_level is None else max_level
        for k, level in enumerate(self.levels(depth)):
            fine = [n for n in level if n.agreement >= agreement]
            alive = {id(n): sum(c.agreement >= agreement for c in n.children.values()) if k < depth else 0 for n in fine}
            if include_splitting == "levels" and any(alive[id(n)] != 1 for n in fine):
                out += fine
            else:
                out += [n for n in fine if alive[id(n)] == 0 or include_splitting == "nodes" and alive[id(n)] == 2]
        return out

    def matrix(self, agreement: float | None = None, max_level: int | None = None, include_splitting: str = "no") -> np.ndarray:
        """Paths of ``maximal`` with zeros after their ends; default: the search limit."""
        agreement = max(1, self.limit()) if agreement is None else agreement
        width = self.number_of_features if max_level is None else min(max_level, self.number_of_features)
        return padded(self.maximal(agreement, max_level, include_splitting), width)

    def at_level(self, k: int, agreement: float, include_splitting: bool = False) -> list[Node]:
        """Nodes of level ``k``, with the splitting nodes above them if asked for."""
        levels = list(self.levels(k))
        nodes = [n for n in levels[k] if n.agreement >= agreement] if len(levels) > k else []
        if include_splitting:
            above = []
            for level in levels[:k]:
                above += [n for n in level if n.agreement >= agreement and sum(c.agreement >= agreement for c in n.children.values()) == 2]
            nodes = above + nodes
        return nodes

    def level_matrix(self, k: int, agreement: float, include_splitting: bool = False) -> np.ndarray:
        return padded(self.at_level(k, agreement, include_splitting), k)

    def distinguishers(self, agreement: float, max_level: int | None = None, ids: bool = True) -> list[int]:
        """Features (or levels) at which some node continues on both sides."""
        out = []
        for k, level in enumerate(self.levels(max_level)):
            if any(len(n.children) == 2 and all(c.agreement >= agreement for c in n.children.values()) for n in level):
                out.append(self.features[k] if ids else k)
        return out

    def pruned(self, agreement: float) -> AccordTree:
        return AccordTree(self.root.copy(lambda n: n.agreement >= agreement), self.features)

    def by_path(self, path: list[int] | tuple[int, ...]) -> Node:
        """The node at the end of a path, or the last one that exists on it."""
        node = self.root
        for s in path:
            if s not in node.children:
                break
            node = node.children[s]
        return node

    def difference_from(self, other: AccordTree) -> str | None:
        """Why this isn't a part of ``other``; None if it is."""
        if self.features != other.features[: len(self.features)]:
            return "features differ"
        todo = [(self.root, other.root)]
        while todo:
            a, b = todo.pop()
            if a.agreement != b.agreement or a.core != b.core:
                return f"{a.path}: {a.agreement} {sorted(a.core)} and {b.agreement} {sorted(b.core)}"
            for s, child in a.children.items():
                if s not in b.children:
                    return f"{child.path}: missing"
                todo.append((child, b.children[s]))
        return None

    def is_part_of(self, other: AccordTree) -> bool:
        return self.difference_from(other) is None

    # -- tables -----------------------------------------------------------------------------
    SCHEMA = "node long, parent long, level int, side int, agreement double, path array<int>, core array<struct<feature:int,side:int>>"

    def table(self, spark: SparkSession) -> DataFrame:
        number = {id(n): k for k, n in enumerate(self.root.walk())}
        rows = [
            (number[id(n)], number.get(id(n.parent)), n.level, n.side, float(n.agreement), list(n.path), sorted(n.core))
            for n in self.root.walk()
        ]
        return spark.createDataFrame(rows, self.SCHEMA)

    def accords(self, spark: SparkSession, agreement: float, include_splitting: str = "no") -> DataFrame:
        """Long form: ``accord, level, feature, side``."""
        nodes = self.maximal(agreement, None, include_splitting)
        rows = [(k, level, self.features[level], s) for k, n in enumerate(nodes) for level, s in enumerate(n.path)]
        return spark.createDataFrame(rows, "accord int, level int, feature int, side int")

    def layout(self, spark: SparkSession) -> DataFrame:
        """``node, parent, x, y``: places for drawing; leaves lie side by side."""
        place: dict[int, float] = {}
        for k, n in enumerate([n for n in _depth_first(self.root) if not n.children]):
            place[id(n)] = float(k)
        nodes = list(self.root.walk())
        for n in reversed(nodes):
            if n.children:
                place[id(n)] = sum(place[id(c)] for c in n.children.values()) / len(n.children)
        number = {id(n): k for k, n in enumerate(nodes)}
        rows = [(number[id(n)], number.get(id(n.parent)), place[id(n)], float(-n.level)) for n in nodes]
        return spark.createDataFrame(rows, "node long, parent long, x double, y double")

    def save(self, spark: SparkSession, folder: str) -> None:
        levels = spark.createDataFrame([(k, f) for k, f in enumerate(self.features)], "level int, feature int")
        self.table(spark).write.mode("overwrite").parquet(f"{folder}/nodes")
        levels.write.mode("overwrite").parquet(f"{folder}/levels")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> AccordTree:
        nodes: dict[int, Node] = {}
        for r in spark.read.parquet(f"{folder}/nodes").orderBy("level", "node").collect():
            core = frozenset((c["feature"], c["side"]) for c in r["core"])
            if r["parent"] is None:
                nodes[r["node"]] = Node(r["agreement"], core)
            else:
                nodes[r["node"]] = nodes[r["parent"]].add(r["side"], r["agreement"], core)
        levels = spark.read.parquet(f"{folder}/levels").orderBy("level").collect()
        return AccordTree(nodes[0], [r["feature"] for r in levels])

    def to_json(self) -> str:
        return json.dumps([[n.path, n.agreement, sorted(n.core)] for n in self.root.walk()])


def _depth_first(node: Node) -> Iterator[Node]:
    yield node
    for s in (-1, 1):
        if s in node.children:
            yield from _depth_first(node.children[s])


def problems(tree: AccordTree, count: Callable[..., float], below: Callable[[Side, Side], bool], size: int = 3) -> list[str]:
    """Broken invariants: agreement falls along paths and is what the core says, cores are
    minimal and only hold chosen sides."""
    from itertools import combinations

    out = []
    for n in tree.root.walk():
        chosen = {(tree.features[k], s) for k, s in enumerate(n.path)}
        if not n.core <= chosen:
            out.append(f"{n.path}: core {sorted(n.core)} has sides that aren't chosen")
        if n.parent is not None and n.agreement > n.parent.agreement:
            out.append(f"{n.path}: agreement rises")
        for a, b in combinations(n.core, 2):
            if below(a, b) or below(b, a):
                out.append(f"{n.path}: {a} and {b} are comparable")
        least = min((count(*c) for k in range(1, size + 1) for c in combinations(n.core, k)), default=tree.root.agreement)
        if n.agreement > least:
            out.append(f"{n.path}: agreement {n.agreement} above {least}")
        if len(n.path) > len(tree.features):
            out.append(f"{n.path}: too deep")
    return out


def read_table(df: DataFrame) -> DataFrame:
    """Maximal nodes of a stored tree table, as a table: those that are nobody's parent."""
    parents = df.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    return df.join(parents, "node", "left_anti")
