"""Making efficient distinguishers nested by corners, and the tree of accords they form.

Corners are functions of columns that exist, so the atoms never change: a corner's counts follow
from theirs. Where the driver can hold the atoms (one row for each distinct row of the first
features, ``max_atoms`` at most) features live there, with their numbers of rows. Beyond that, and
for orders that need the rows themselves, features are expressions over the table, and every
question is an aggregate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import counts
from ..operators.corners import CORNERS, column_keys
from ..operators.orders import create_order
from ..sources.storage import stored
from .search import Sweep
from .tree import AccordTree, Side


#: Distinct rows that the driver holds.
MAX_ATOMS = 1_000_000


class AtomSystem:
    """Features as columns over atoms with weights. Equal columns, or negated ones, are one."""

    def __init__(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.weights = np.asarray(weights, np.int64)
        self.columns: list[np.ndarray] = []
        self.meta: list[tuple] = []
        self.ids: dict[bytes, tuple[int, int]] = {}
        for k, col in enumerate(np.asarray(values, np.int8).T):
            self.add(col, ("custom", k))

    @staticmethod
    def of(df: DataFrame, names: Sequence[str], max_atoms: int = MAX_ATOMS) -> AtomSystem | None:
        """None if there are more atoms."""
        rows = counts.atoms(df, names).limit(max_atoms + 1).toPandas()
        if len(rows) > max_atoms:
            return None
        rows = rows.sort_values(list(names))
        return AtomSystem(rows[list(names)].to_numpy(), rows["w"].to_numpy())

    @property
    def size(self) -> int:
        return len(self.columns)

    def total(self) -> int:
        return int(self.weights.sum())

    def find(self, col: np.ndarray) -> tuple[int, int]:
        return self.ids.get(np.ascontiguousarray(col, np.int8).tobytes(), (-1, 1))

    def add(self, col: np.ndarray, meta: tuple) -> tuple[int, int]:
        found = self.find(col)
        if found[0] < 0:
            col = np.ascontiguousarray(col, np.int8)
            found = (len(self.columns), 1)
            self.columns.append(col)
            self.meta.append(meta)
            self.ids.setdefault(col.tobytes(), found)
            self.ids.setdefault((-col).tobytes(), (found[0], -1))
        return found

    def corner(self, a: int, oa: int, b: int, ob: int) -> np.ndarray:
        return np.minimum(self.columns[a] * oa, self.columns[b] * ob)

    def count(self, *oriented: Side) -> int:
        inside = np.ones(len(self.weights), bool)
        for f, s in oriented:
            inside &= self.columns[f] * s > 0
        return int(self.weights[inside].sum())

    def below(self, a: Side, b: Side) -> bool:
        x, y = self.columns[a[0]] * a[1], self.columns[b[0]] * b[1]
        return not (((x >= 0) & (y < 0)) | ((y <= 0) & (x > 0))).any()

    def nested(self, a: int, b: int) -> bool:
        return any(self.below((a, oa), (b, ob)) for oa in (-1, 1) for ob in (-1, 1))

    def smaller_side(self, f: int) -> int:
        c = self.columns[f]
        return int(min(self.weights[c >= 0].sum(), self.weights[c <= 0].sum()))

    def side_counts(self, f: int) -> tuple[int, int]:
        c = self.columns[f]
        return int(self.weights[c >= 0].sum()), int(self.weights[c <= 0].sum())

    def lean(self, f: int) -> int:
        return abs(int((self.columns[f] * self.weights).sum()))

    def tie(self, f: int) -> tuple:
        """What settles ties of rank: the column from its last atom on, descending."""
        c = self.columns[f]
        return tuple((-c * (-1 if c[0] < 0 else 1))[::-1].tolist())


class _Tie:
    """Compares two features of a table by the last row in which they differ."""

    def __init__(self, system: TableSystem, f: int) -> None:
        self.system, self.f = system, f

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Tie) and self.f == other.f

    def __lt__(self, other: _Tie) -> bool:
        return self.system.comes_first(self.f, other.f)


class TableSystem:
    """Features as expressions over a table of any size. Equal columns, or negated ones, are one:
    they share the sums of hashes of their rows. ``order`` is a function of a table and its
    features. Answers are remembered; now and then corners are written out as columns."""

    def __init__(self, df: DataFrame, names: Sequence[str], order: Callable[[DataFrame, Sequence[str]], DataFrame], id_col: str = "pid") -> None:
        self.df, self.id_col, self.orders = df.select(id_col, *names), id_col, order
        self.columns: list[Column] = []
        self.meta: list[tuple] = []
        self.ids: dict[tuple, tuple[int, int]] = {}
        self.known: dict[tuple, object] = {}
        self.firsts = list(names)
        keys = column_keys(self.df, self.firsts, id_col)
        for k, n in enumerate(names):
            self._register(F.col(n), ("custom", k), keys[n])

    @property
    def size(self) -> int:
        return len(self.columns)

    def total(self) -> int:
        return self._once(("total",), lambda: self.df.count())

    def _once(self, key: tuple, find: Callable[[], object]):  # noqa: ANN202
        if key not in self.known:
            self.known[key] = find()
        return self.known[key]

    def _register(self, col: Column, meta: tuple, keys: tuple) -> tuple[int, int]:
        plus, minus = keys
        if plus in self.ids:
            return self.ids[plus]
        found = (len(self.columns), 1)
        self.columns.append(col)
        self.meta.append(meta)
        self.ids[plus], self.ids[minus] = found, (found[0], -1)
        return found

    def corner(self, a: int, oa: int, b: int, ob: int) -> Column:
        return F.least(self.columns[a] * F.lit(oa), self.columns[b] * F.lit(ob)).cast("tinyint")

    def add(self, col: Column, meta: tuple) -> tuple[int, int]:
        keys = column_keys(self.df.select(self.id_col, col.alias("c")), ["c"], self.id_col)["c"]
        found = self._register(col, meta, keys)
        if found[0] == len(self.columns) - 1 and len(self.columns) % 8 == 0:
            self._write()
        return found

    def _write(self) -> None:
        """Corners of corners as columns, so that expressions stay small."""
        names = [f"x{i}" for i in range(len(self.columns))]
        firsts = [n for n in self.firsts if n not in names]
        self.df = stored(self.df.select(self.id_col, *firsts, *[c.alias(n) for c, n in zip(self.columns, names, strict=True)]), "corners")
        self.columns = [F.col(n) for n in names]

    def many(self, sets: Sequence[frozenset[Side]]) -> None:
        """Count all sets that aren't known yet, a few hundred to a pass."""
        new = [s for s in dict.fromkeys(sets) if ("count", s) not in self.known]
        for at in range(0, len(new), 300):
            part = new[at : at + 300]
            on = [reduce(Column.__and__, [self.columns[f] * F.lit(o) > 0 for f, o in s], F.lit(True)) for s in part]
            r = self.df.agg(*[F.count_if(x).alias(f"n{k}") for k, x in enumerate(on)]).first()
            self.known.update({("count", s): r[f"n{k}"] for k, s in enumerate(part)})

    def count(self, *oriented: Side) -> int:
        key = frozenset(oriented)
        self.many([key])
        return self.known["count", key]

    def _against(self, a: int, b: int) -> dict[tuple[int, int], bool]:
        """For all orientations of two features, whether the first lies below the second."""
        def find() -> dict[tuple[int, int], bool]:
            x, y = self.columns[a], self.columns[b]
            sides = [(p, q) for p in (-1, 1) for q in (-1, 1)]
            bad = [F.count_if(((x * p >= 0) & (y * q < 0)) | ((y * q <= 0) & (x * p > 0))).alias(f"n{k}") for k, (p, q) in enumerate(sides)]
            r = self.df.agg(*bad).first()
            return {s: r[f"n{k}"] == 0 for k, s in enumerate(sides)}

        return self._once(("below", a, b), find)

    def below(self, a: Side, b: Side) -> bool:
        return a == b if a[0] == b[0] else self._against(a[0], b[0])[a[1], b[1]]

    def nested(self, a: int, b: int) -> bool:
        return any(self._against(a, b).values()) or any(self._against(b, a).values())

    def side_counts(self, f: int) -> tuple[int, int]:
        def find() -> tuple[int, int]:
            r = self.df.agg(F.count_if(self.columns[f] >= 0).alias("a"), F.count_if(self.columns[f] <= 0).alias("b")).first()
            return r["a"], r["b"]

        return self._once(("sides", f), find)

    def smaller_side(self, f: int) -> int:
        return min(self.side_counts(f))

    def lean(self, f: int) -> int:
        return self._once(("lean", f), lambda: abs(self.df.agg(F.coalesce(F.sum(self.columns[f]), F.lit(0)).alias("s")).first()["s"]))

    def order(self, f: int) -> float:
        """Ranked among the first features, as orders of pairs need."""
        def find() -> float:
            firsts = [self.columns[k].alias(f"f{k}") for k, m in enumerate(self.meta) if m[0] == "custom" and k != f]
            names = [*[f"f{k}" for k, m in enumerate(self.meta) if m[0] == "custom" and k != f], "own"]
            table = self.df.select(self.id_col, *firsts, self.columns[f].alias("own"))
            return float(self.orders(table, names).where(F.col("feature") == len(names) - 1).first()["value"])

        return self._once(("order", f), find)

    def tie(self, f: int) -> _Tie:
        return _Tie(self, f)

    def comes_first(self, a: int, b: int) -> bool:
        def find() -> bool:
            start = self.df.agg(*[F.min_by(self.columns[f], self.id_col).alias(n) for f, n in ((a, "a"), (b, "b"))]).first()
            x, y = (self.columns[f] * F.lit(-1 if start[n] < 0 else 1) for f, n in ((a, "a"), (b, "b")))
            r = self.df.agg(F.max_by(x - y, F.when(x != y, F.col(self.id_col))).alias("d")).first()["d"]
            return (r or 0) > 0

        return self._once(("tie", a, b), find)


class Ranking:
    """A rank without ties: order rounded to ten digits, least balanced first, then columns."""

    def __init__(self, system: AtomSystem | TableSystem, order: Callable[..., float]) -> None:
        self.system, self.order, self.known = system, order, {}

    def key(self, f: int) -> tuple:
        if f not in self.known:
            self.known[f] = (round(float(self.order(self.system, f)), 10), -self.system.lean(f), self.system.tie(f), f)
        return self.known[f]

    def place(self, ranked: Sequence[int], f: int) -> int:
        return bisect_left([self.key(g) for g in ranked], self.key(f))


def balance_order(system: AtomSystem, f: int) -> float:
    return -abs(int((system.columns[f] * system.weights).sum()))


def pair_order(system: AtomSystem, f: int) -> float:
    """The submodular order of pairs parted here but not by the first features."""
    c, w = system.columns[f], system.weights
    total = 0
    for g, meta in zip(system.columns, system.meta, strict=True):
        if meta[0] == "custom":
            for s in (g >= 0, g <= 0):
                total += int(w[s & (c >= 0)].sum()) * int(w[s & (c <= 0)].sum())
    return float(total)


def most_balanced(system: AtomSystem | TableSystem, fitting: Sequence[int]) -> list[int]:
    """Of the corners that fit, the one whose smaller side is largest."""
    return [max(fitting, key=system.smaller_side)]


def all_fitting(system: AtomSystem | TableSystem, fitting: Sequence[int]) -> list[int]:
    return list(fitting)


class _Counts:
    """A system's counts, asked for many at a time where it can."""

    def __init__(self, system: AtomSystem | TableSystem) -> None:
        self.system = system

    def many(self, sets: Sequence[frozenset[Side]]) -> None:
        if hasattr(self.system, "many"):
            self.system.many(sets)

    def __call__(self, *oriented: Side) -> int:
        return self.system.count(*oriented)


class UncrossingSweep:
    """Appends features by rank; after each, efficient distinguishers that cross are replaced by
    corners of smaller rank until they are nested (or nothing new can be added). ``choose``: which
    of the corners that fit are added."""

    def __init__(
        self, system: AtomSystem | TableSystem, order: Callable[..., float] = pair_order, agreement: int | None = None,
        choose: Callable[..., list[int]] = most_balanced,
    ) -> None:
        self.system, self.choose = system, choose
        self.agreement = max(1, system.total() // 5) if agreement is None else agreement
        self.ranking = Ranking(system, order)
        self.waiting = sorted(range(system.size), key=self.ranking.key)
        self.first = set(self.waiting)
        self.sweep = Sweep(_Counts(system), system.below)
        self.messages: list[str] = []

    @property
    def tree(self) -> AccordTree:
        return self.sweep.tree

    def append_next(self, n: int | None = None) -> None:
        for _ in range(len(self.waiting) if n is None else min(n, len(self.waiting))):
            f = self.waiting.pop(0)
            at = self.ranking.place(self.tree.features, f)
            self.sweep.insert(at, f, self.agreement)
            self.uncross()

    def crossing(self) -> tuple[int, int] | None:
        found = self.tree.distinguishers(self.agreement)
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                if not self.system.nested(a, b):
                    return a, b
        return None

    def uncross(self) -> bool:
        while (pair := self.crossing()) is not None:
            top = max(self.ranking.key(f) for f in pair)
            fitting = []
            for oa, ob in CORNERS:
                col = self.system.corner(pair[0], oa, pair[1], ob)
                f, _ = self.system.add(col, ("inf", (pair[0], oa), (pair[1], ob)))
                if self.ranking.key(f) < top:
                    fitting.append(f)
            new = [f for f in dict.fromkeys(fitting) if f not in self.tree.features]
            if len(fitting) < 2 or not new:
                self.messages.append(f"features {pair} stay crossing")
                return False
            for best in self.choose(self.system, new):
                self.sweep.progress("uncross", crossing=pair, corner=best)
                self.sweep.insert(self.ranking.place(self.tree.features, best), best, self.agreement)
        return True

    def lower_agreement(self, agreement: int) -> None:
        self.agreement = agreement
        self.sweep.sweep_below(agreement)
        self.uncross()

    def sweep_one(self) -> float:
        """Lower the agreement to the search's limit, where new nodes appear; returns the new
        limit."""
        if self.tree.limit() > 0:
            self.lower_agreement(int(self.tree.limit()))
        return self.tree.limit()

    def sweep_stepwise(self, agreement: int) -> None:
        """Down to ``agreement``, limit by limit, uncrossing after each."""
        while self.tree.limit() > agreement:
            self.sweep_one()
        self.lower_agreement(agreement)

    def order_of(self, f: int) -> float:
        return float(self.ranking.order(self.system, f))

    def orders(self) -> list[float]:
        """The order of each level's feature."""
        return [self.order_of(f) for f in self.tree.features]

    def oriented(self, agreement: int | None = None) -> list[int]:
        """Features of which some accord has a side."""
        m = self.tree.matrix(self.agreement if agreement is None else agreement)
        return [f for k, f in enumerate(self.tree.features) if (m[:, k] != 0).any()]

    def matrix(self, agreement: int | None = None, only_first: bool = False) -> np.ndarray:
        m = self.tree.matrix(self.agreement if agreement is None else agreement)
        return m[:, [k for k, f in enumerate(self.tree.features) if f in self.first]] if only_first else m

    def tree_of_accords(self, agreement: int | None = None) -> AccordGraph:
        agreement = self.agreement if agreement is None else agreement
        levels = self.tree.distinguishers(agreement, ids=False)
        nodes = self.tree.maximal(agreement)
        paths = [n.path for n in nodes]
        kept = [[p[k] if k < len(p) else 0 for k in levels] for p in paths]
        return AccordGraph.build(np.array(kept, np.int8).reshape(len(kept), len(levels)), [self.tree.features[k] for k in levels], self.system.below)


@dataclass
class AccordGraph:
    """Accords joined by the features that part them: a tree if those are nested. Edges:
    (accord, accord, feature)."""

    matrix: np.ndarray
    features: list[int]
    edges: list[tuple[int, int, int]] = field(default_factory=list)

    @staticmethod
    def build(matrix: np.ndarray, features: list[int], below: Callable[[Side, Side], bool]) -> AccordGraph:
        """Each feature parts the accords in two; those nearest to it on either side, by the
        features that separate them from it, are joined."""
        out = AccordGraph(matrix, features)

        def nearest(rows: np.ndarray, k: int, side: int) -> int:
            best, least = int(rows[0]), None
            for r in rows:
                # Features between this accord and the edge: its side there points to the edge.
                apart = sum(
                    matrix[r, j] != 0 and j != k and below((features[k], side), (features[j], -int(matrix[r, j])))
                    for j in range(len(features))
                )
                if least is None or apart < least:
                    best, least = int(r), apart
            return best

        for k, f in enumerate(features):
            left, right = np.flatnonzero(matrix[:, k] < 0), np.flatnonzero(matrix[:, k] > 0)
            if len(left) and len(right):
                out.edges.append((nearest(left, k, 1), nearest(right, k, -1), f))
        return out

    def star(self, accord: int) -> list[Side]:
        """The sides that point from an accord's edges to it."""
        return [(f, int(self.matrix[accord, self.features.index(f)])) for a, b, f in self.edges if accord in (a, b)]

    def is_tree(self) -> bool:
        parent = list(range(len(self.matrix)))

        def top(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b, _ in self.edges:
            if top(a) == top(b):
                return False
            parent[top(a)] = top(b)
        return len({top(x) for x in range(len(parent))}) <= 1

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
        nodes = spark.createDataFrame([(k, [int(x) for x in row]) for k, row in enumerate(self.matrix)], "accord int, sides array<int>")
        return nodes, spark.createDataFrame(self.edges, "src int, dst int, feature int")

    def neighbours(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {k: [] for k in range(len(self.matrix))}
        for a, b, _ in self.edges:
            out[a].append(b)
            out[b].append(a)
        return out

    def distances(self, start: int) -> dict[int, int]:
        found, todo, near = {start: 0}, [start], self.neighbours()
        for x in todo:
            for y in near[x]:
                if y not in found:
                    found[y] = found[x] + 1
                    todo.append(y)
        return found

    def shortest_path(self, a: int, b: int) -> list[int]:
        far, near, path = self.distances(a), self.neighbours(), [b]
        while path[-1] != a:
            path.append(min(near[path[-1]], key=lambda x: far.get(x, 1 << 30)))
        return path[::-1]

    def split(self, edge: int) -> tuple[set[int], set[int]]:
        """Accords on either side of an edge."""
        rest = AccordGraph(self.matrix, self.features, [e for k, e in enumerate(self.edges) if k != edge])
        one = set(rest.distances(self.edges[edge][0]))
        return one, set(range(len(self.matrix))) - one

    def max_degree(self) -> int:
        return max(map(len, self.neighbours().values()), default=0)


#: Orders that atoms with their numbers of rows are enough for.
ATOM_ORDERS: dict[str, Callable[..., float]] = {"O1": pair_order, "balance": balance_order}


def search_uncrossed(
    df: DataFrame, names: Sequence[str], min_agreement: int, order: str | Callable = "O1", max_features: int | None = None,
    edges: DataFrame | None = None, id_col: str = "pid", max_atoms: int = MAX_ATOMS, choose: Callable[..., list[int]] = most_balanced,
) -> UncrossingSweep:
    """``order``: the name of an order (those of graphs take ``edges``), a function of a table and
    its features, or one of ``ATOM_ORDERS``' functions. Orders of atoms are searched on the driver
    as long as there are at most ``max_atoms``; all else over the table, with the same results."""
    by_name = {f: n for n, f in ATOM_ORDERS.items()}
    name = by_name.get(order, order)
    if name in ATOM_ORDERS and (system := AtomSystem.of(df, names, max_atoms)) is not None:
        out = UncrossingSweep(system, ATOM_ORDERS[name], min_agreement, choose)
    else:
        system = TableSystem(df, names, create_order(name, edges, id_col) if isinstance(name, str) else order, id_col)
        out = UncrossingSweep(system, TableSystem.order, min_agreement, choose)
    out.append_next(max_features)
    return out
