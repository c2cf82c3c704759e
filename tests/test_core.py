"""Golden values and brute force for features, counts, orders, search, analysis and graphs."""

import math
import os
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sidewise.functions import entropy, logic, scaling
from sidewise.functions.intervals import IntervalUnion
from sidewise.operators import analysis, corners, counts, features, graphs, orders, surveys
from sidewise.plans import catalog, search, uncross
from sidewise.plans.tree import AccordTree, Node, problems
from sidewise.sources import generators
from sidewise.sources import surveys as files
from sidewise.streaming import atoms as streams

INF = math.inf


def table(spark, values, names=None):
    return generators.from_matrix(spark, values, names)


@pytest.fixture(scope="module")
def random_sides(spark):
    r = np.random.default_rng(0)
    values = np.where(r.random((40, 6)) < 0.5, -1, 1)
    names = [f"f{i}" for i in range(6)]
    return values, names, table(spark, values.tolist(), names).cache()


# -- counts and search -----------------------------------------------------------------------
def brute_accords(values, agreement, size=3):
    """All paths whose every set of up to ``size`` sides shares enough rows."""
    n, k = values.shape
    out = {(): n}
    level = {(): n}
    for f in range(k):
        new = {}
        for path, a in level.items():
            if a < agreement:
                continue
            for s in (-1, 1):
                chosen = [*enumerate(path), (f, s)]
                least = min(int(np.all([values[:, g] * o > 0 for g, o in c], axis=0).sum()) for m in range(1, size + 1) for c in combinations(chosen, m))
                new[(*path, s)] = min(a, least)
        level = {p: a for p, a in new.items() if a >= agreement}
        out.update(level)
    return out


@pytest.mark.parametrize("agreement", [2, 4, 6])
def test_search_against_all_subsets(random_sides, agreement):
    values, names, df = random_sides
    found = search.search(df, names, agreement)
    got = {n.path: n.agreement for n in found.tree.root.walk() if n.agreement >= agreement}
    assert got == brute_accords(values, agreement)
    assert problems(found.tree, found.counter, found.sweep.below) == []


def test_search_orders_inserts_and_resumes(random_sides):
    values, names, df = random_sides
    whole = search.search(df, names, 3)
    other = search.Search(df, names)
    for f in (0, 2, 4):
        other.sweep.append(f, 3)
    for at, f in ((1, 1), (3, 3), (5, 5)):
        other.sweep.insert(at, f, 3)
    assert {n.path: n.agreement for n in whole.tree.pruned(3).root.walk()} == {n.path: n.agreement for n in other.tree.pruned(3).root.walk()}
    lowered = search.search(df, names, 8, max_features=6)
    lowered.tree.features[:] = list(range(6))
    lowered.lower_agreement(3)
    assert lowered.tree.pruned(3).is_part_of(whole.tree.pruned(3))
    assert whole.tree.level_sizes(3)[0] == 1 and whole.tree.height(41) == 0
    assert whole.tree.limit() < 3 or whole.tree.limit() == 0 or whole.tree.limit() <= 3
    assert len(whole.sweep.greedy(2, 3)) <= 4


def test_forced_sides_and_cores(spark):
    # f0 = 1 implies f1 = 1.
    df = table(spark, [[1, 1], [1, 1], [-1, 1], [-1, -1], [-1, -1]])
    found = search.search(df, ["f0", "f1"], 1)
    right = found.tree.root.right
    assert set(right.children) == {1} and right.right.core == frozenset({(0, 1)})


def test_scan_counter_matches_primed(spark):
    r = np.random.default_rng(5)
    values = np.where(r.random((60, 14)) < 0.5, -1, 1)
    names = [f"f{i}" for i in range(14)]
    df = table(spark, values.tolist(), names)
    counter = counts.Counter(df, names)
    assert counter((0, 1), (3, -1), (13, 1)) == int(((values[:, 0] > 0) & (values[:, 3] < 0) & (values[:, 13] > 0)).sum())
    real = counts.Counter(table(spark, [[1.5, 2.0], [-1.0, 3.0], [2.0, 0.5]], ["a", "b"]), ["a", "b"], real=True)
    assert real((0, 1), (1, 1)) == pytest.approx(6.0)


def test_tree_readers_and_storage(spark, random_sides, tmp_path):
    _, names, df = random_sides
    tree = search.search(df, names, 4).tree
    assert tree.matrix(4).shape[1] == 6
    tree.save(spark, str(tmp_path / "tree"))
    back = AccordTree.load(spark, str(tmp_path / "tree"))
    assert back.is_part_of(tree) and tree.is_part_of(back)
    assert tree.accords(spark, 4).select("accord").distinct().count() == len(tree.maximal(4))
    assert tree.layout(spark).count() == tree.table(spark).count()
    assert len(tree.maximal(4, include_splitting="levels")) >= len(tree.maximal(4, include_splitting="nodes")) >= len(tree.maximal(4))
    paths = tree.matrix(4)
    assert sorted(map(tuple, [np.pad(n.path, (0, 6 - len(n.path))) for n in Node.from_paths(paths).leaves()])) == sorted({tuple(p) for p in paths} - {tuple(p) for p in paths if any((p[p != 0] == q[: (p != 0).sum()]).all() and (q != 0).sum() > (p != 0).sum() for q in paths)})
    assert all(len(n.children) in (0, 2) for n in tree.root.without_single_parents().walk())


def test_certificate(spark, random_sides):
    """Every leaf's reason has too few rows, its sides are chosen on the path, and what is
    irreducible still covers every path."""
    values, names, df = random_sides
    found = search.search(df, names, 12)
    assert found.tree.height(12) < 6
    cert = search.Certificate.create(found.sweep, 12)

    def leaves(c, chosen=frozenset()):
        if not c.children:
            yield c, chosen
        for s, child in c.children.items():
            yield from leaves(child, chosen | {(c.feature, s)})

    for c in (cert, cert.irreducible()):
        seen = 0
        for leaf, chosen in leaves(c):
            assert leaf.reason <= chosen and len(leaf.reason) <= 3
            assert int(np.all([values[:, f] * o > 0 for f, o in leaf.reason], axis=0).sum()) < 12
            seen += 2.0 ** -len(chosen)
        assert seen == 1  # every choice of sides ends at one leaf
    assert cert.irreducible().needs() <= cert.needs()
    assert len(cert.irreducible().features()) <= len(cert.features())


def test_levels_of_maximal_nodes(spark, random_sides):
    _, names, df = random_sides
    tree = search.search(df, names, 4).tree
    alive = lambda n: sum(c.agreement >= 4 for c in n.children.values())
    levels = [[n for n in level if n.agreement >= 4] for level in tree.levels()]
    want = [n.path for level in levels for n in level if any(alive(m) != 1 for m in level)]
    assert [n.path for n in tree.maximal(4, include_splitting="levels")] == want
    assert [n.path for n in tree.maximal(4, include_splitting="nodes")] == [n.path for level in levels for n in level if alive(n) != 1]
    assert all(len(n.path) <= 2 for n in tree.maximal(4, 2)) and {n.path for n in tree.maximal(4, 2)} >= {n.path for n in levels[2]}


def test_order_of_real_features(spark):
    df = table(spark, [[3.0, 1.0, -3.0], [-1.0, -2.0, 1.0]], ["a", "b", "c"])
    below = search.Order(df, ["a", "b", "c"], real=True)
    values = {0: [3, -1], 1: [1, -2], 2: [-3, 1]}
    for i in range(3):
        for j in range(3):
            for oi in (-1, 1):
                for oj in (-1, 1):
                    if i != j:
                        assert below((i, oi), (j, oj)) == all(oi * x <= oj * y for x, y in zip(values[i], values[j], strict=True))
    found = search.search(df, ["a", "b", "c"], 0.5, real=True)
    assert problems(found.tree, found.counter, found.sweep.below) == []


def test_guided(spark):
    fruit = [(-1, -1, 1), (-1, 1, -1), (-1, 1, -1), (-1, 1, 1), (1, 1, 1), (1, 1, 1)]
    df = table(spark, fruit).withColumn("citrus", F.col("pid").between(1, 3)).withColumn("none", F.lit(False))
    names = ["f0", "f1", "f2"]
    found = search.search(df, names, 1)
    node = search.guided(found.tree, df, names, "citrus")
    assert node.path == (-1, 1, -1) and search.is_guiding(node, df, names, "citrus")
    assert search.guided(found.tree, df, names, "none").path == ()


def test_atoms_and_sides(spark):
    df = table(spark, [[1, -1], [1, -1], [-1, 0]], ["a", "b"])
    numbered = counts.atomic_sets(df, ["a", "b"])
    member = counts.membership(df, numbered, ["a", "b"])
    assert sorted(tuple(r) for r in member.collect()) == [(0, 1), (1, 1), (2, 0)]
    assert counts.from_atomic(counts.to_atomic(df, member, ["a", "b"]), member).where("a = 1 AND b = -1").count() == 2
    sides = {r["feature"]: (r["positive"], r["ge_zero"], r["le_zero"]) for r in counts.side_counts(df, ["a", "b"]).collect()}
    assert sides == {"a": (2, 2, 1), "b": (0, 1, 3)}
    assert counts.first_crossing(table(spark, [[1, 1], [1, -1], [-1, 1], [-1, -1]], ["a", "b"]), ["a", "b"]) == (0, 1)
    assert generators.encoding(df, ["a", "b"]) == "set"


def test_corners_and_identity(spark, random_sides):
    values, names, df = random_sides
    base = [features.Feature(n, F.col(n)) for n in names[:3]]
    made = corners.with_corners(df, base)
    got = df.select(*[f.column.alias(str(i)) for i, f in enumerate(made)]).toPandas().to_numpy()
    want = {tuple(c * (1 if c[0] > 0 else -1)) for c in values[:, :3].T}
    for a, b in combinations(range(3), 2):
        for oa, ob in corners.CORNERS:
            c = np.minimum(values[:, a] * oa, values[:, b] * ob)
            want.add(tuple(c * (1 if c[0] > 0 else -1)))
    assert {tuple(c * (1 if c[0] > 0 else -1)) for c in got.T} == want and got.shape[1] == len(want)
    more = df.withColumn("g", -F.col("f1"))
    assert corners.lookup(more, names, ["g", "f2"]) == [(1, -1), (2, 1)]
    assert corners.lookup(df.withColumn("h", F.lit(1)), names, ["h"]) == [(-1, 1)]
    some = corners.corner_features(df, base, 8, order=orders.order_balance, max_order_factor=1.0)
    lean = lambda c: -abs(int(c.sum()))
    want = []
    for a, b in combinations(range(3), 2):
        for oa, ob in corners.CORNERS:
            c = np.minimum(values[:, a] * oa, values[:, b] * ob)
            fits = min((c > 0).sum(), (c < 0).sum()) >= 8 and lean(c) <= max(lean(values[:, a]), lean(values[:, b]))
            known = any((c == s * values[:, k]).all() for k in range(3) for s in (1, -1)) or any((c == s * w).all() for w, _ in want for s in (1, -1))
            if fits and not known:
                want.append((c, f"inf({oa:+d} f{a}, {ob:+d} f{b})"))
    assert [f.name for f in some] == [name for _, name in want] and want


@pytest.mark.parametrize("kind", ["atoms", "table"])
def test_uncrossing_on_atoms_and_tables(spark, kind):
    r = np.random.default_rng(3)
    values = np.where(r.random((120, 4)) < 0.5, -1, 1)
    values[:60, :2] = np.where(r.random((60, 2)) < 0.9, 1, -1)
    values[60:, :2] = np.where(r.random((60, 2)) < 0.9, -1, 1)
    names = [f"f{i}" for i in range(4)]
    df = table(spark, values.tolist(), names)
    found = uncross.search_uncrossed(df, names, 8, "O1", max_atoms=1000 if kind == "atoms" else 1)
    assert isinstance(found.system, uncross.AtomSystem if kind == "atoms" else uncross.TableSystem)
    whole = uncross.search_uncrossed(df, names, 8)
    assert [found.order_of(f) for f in found.tree.features] == whole.orders()
    assert {n.path for n in found.tree.maximal(8)} == {n.path for n in whole.tree.maximal(8)}
    assert found.crossing() is None or found.messages
    pairs = [found.tree.distinguishers(8)]
    if not found.messages:
        assert all(found.system.nested(a, b) for ids in pairs for a, b in combinations(ids, 2))
        assert found.tree_of_accords().is_tree()
    least = whole.tree.limit()
    whole.sweep_one()
    assert whole.tree.limit() <= least and set(whole.oriented()) <= set(whole.tree.features)
    every = uncross.search_uncrossed(df, names, 8, choose=uncross.all_fitting)
    assert every.crossing() is None or every.messages


def test_uncrossing_by_a_graph_order(spark):
    names = list("abc")
    points = table(spark, [[1, 1, -1], [1, -1, -1], [1, -1, 1], [-1, -1, 1], [-1, 1, 1], [-1, 1, -1]], names)
    ring = [(i, (i + 1) % 6) for i in range(6)]
    edges = spark.createDataFrame([(x, y, 1.0) for p in ring for x, y in (p, p[::-1])], "src long, dst long, w double")
    found = uncross.search_uncrossed(points, names, 1, "cut", edges=edges)
    cut = lambda f: values_of(orders.cut_weight(edges, found.system.df.select("pid", found.system.columns[f].alias("x")), ["x"]))[0]
    assert found.orders() == [cut(f) for f in found.tree.features]
    assert found.orders() == sorted(found.orders())


def test_uncrossing_gives_a_tree(spark):
    r = np.random.default_rng(8)
    centers = [(0, 0), (6, 0), (0, 6), (6, 6)]
    points = np.concatenate([r.normal(c, 0.7, (25, 2)) for c in centers])
    df = table(spark, points.tolist(), ["x", "y"])
    found = features.axis_thresholds(df, ["x", "y"], 3)
    named = [f.named(f"f{i}") for i, f in enumerate(found)]
    wide = features.matrix(df, named)
    result = uncross.search_uncrossed(wide, [f.name for f in named], 15)
    assert result.crossing() is None and not result.messages
    assert len(result.tree.maximal(15)) >= 4
    graph = result.tree_of_accords(15)
    assert graph.is_tree()
    a, b = graph.split(0)
    assert a | b == set(range(len(graph.matrix))) and not a & b
    assert graph.shortest_path(0, len(graph.matrix) - 1)[0] == 0 and graph.max_degree() >= 1


# -- orders ----------------------------------------------------------------------------------
def values_of(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: r["feature"])]


def test_cuts_on_a_path(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    names = list("abcd")
    points = table(spark, [[1, -1, -1, 1], [-1, 1, 1, 1], [-1, 1, -1, 1]], names)
    assert values_of(orders.cut_weight(edges, points, names)) == [2, 2, 1, 0]
    assert values_of(orders.ratio_cut(edges, points, names)) == [3, 3, 1.5, 0]
    assert values_of(orders.normalised_cut(edges, points, names)) == pytest.approx([2, 2, 4 / 3, 0])
    lap = graphs.laplacian(edges)
    assert values_of(orders.matrix_order(lap, points, names)) == [8, 8, 4, 0]
    change = {r["pid"]: r["change"] for r in orders.discrete_derivative(edges, points, "c").collect()}
    assert change == {0: 0.0, 1: -1.0, 2: 1.0}
    for kind, f in (("ratio", orders.ratio_cut), ("normalised", orders.normalised_cut)):
        found = {r["pid"]: r["change"] for r in orders.discrete_derivative(edges, points, "c", kind=kind).collect()}
        for p in range(3):
            moved = points.withColumn("c", F.when(F.col("pid") == p, -F.col("c")).otherwise(F.col("c")))
            assert found[p] == pytest.approx(values_of(f(edges, moved, ["c"]))[0] - values_of(f(edges, points, ["c"]))[0])
    best = graphs.minimize_order(edges, points, "c")
    assert best.select(F.sum("c")).first()[0] in (-3, 3)


def test_pair_orders_against_loops(random_sides):
    values, names, df = random_sides
    want = {"O1": [], "O1b": [], "O2": [], "O3": []}
    for f in range(6):
        sums = dict.fromkeys(want, 0)
        for g in range(6):
            c = [[int(((values[:, f] * x > 0) & (values[:, g] * y > 0)).sum()) for y in (1, -1)] for x in (1, -1)]
            sums["O1b"] += c[0][0] * c[1][0]
            sums["O1"] += c[0][0] * c[1][0] + c[0][1] * c[1][1]
            sums["O3"] += min(c[0][0], c[1][0])
            sums["O2"] += min(c[0][0], c[1][0]) + min(c[0][1], c[1][1])
        for k, v in sums.items():
            want[k].append(v)
    for k, v in want.items():
        assert values_of(orders.create_order(k)(df, names)) == v
    with pytest.raises(ValueError, match="unknown"):
        orders.works_on_features("O99")


def test_injective_rank_by_brute_force(spark):
    r = np.random.default_rng(12)
    values = np.where(r.random((8, 7)) < 0.5, -1, 1)
    values[:, 6] = -values[:, 2]  # equal up to sign: by position
    names = [f"f{i}" for i in range(7)]
    df = table(spark, values.tolist(), names)
    for order, value in ((orders.order_balance, lambda c: -abs(int(c.sum()))), (lambda d, n: orders.order_balance(d, n).withColumn("value", F.lit(0.5)), lambda c: 0.5)):
        key = lambda k: (round(value(values[:, k]), 10), -abs(int(values[:, k].sum())), tuple((-values[:, k] * values[0, k])[::-1]), k)  # noqa: B023, E731
        want = sorted(range(7), key=key)
        found = orders.injective_rank(df, names, order(df, names)).collect()
        assert [x["feature"] for x in sorted(found, key=lambda x: x["rank"])] == want


def test_numeric_orders(spark, random_sides):
    values, names, df = random_sides
    r = np.random.default_rng(1)
    a = r.normal(size=(40, 3))
    both = df.join(table(spark, a.tolist(), ["x", "y", "z"]), "pid")
    order = orders.SpectralOrder(both, ["x", "y", "z"], variance_explained=2.0)
    want = ((a.T @ values) ** 2).sum(axis=0)
    assert values_of(order.values(both, names)) == pytest.approx(want.tolist())
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    for share in (0.5, 0.9):
        n = int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= share)) or 3
        part = orders.SpectralOrder(both, ["x", "y", "z"], share, shift=0.25)
        want = ((u[:, :n].T @ values * s[:n, None]) ** 2).sum(axis=0) + 0.25 * values.sum(axis=0) ** 2
        assert values_of(part.values(both, names)) == pytest.approx(want.tolist())
        f = np.array([[1, 1], [-1, 1], [1, -1]])
        cols = orders.SpectralOrder(both, ["x", "y", "z"], share, mode="cols")
        want = ((vt[:n] @ f * s[:n, None]) ** 2).sum(axis=0)
        assert cols.of_columns(f) == pytest.approx(want) and values_of(cols.values(table(spark, f.tolist(), ["g", "h"]), ["g", "h"])) == pytest.approx(want.tolist())
    dense = a @ a.T + np.eye(40)
    entries = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(40)], "src long, dst long, w double")
    assert values_of(orders.log_determinant_order(entries, df, names)) == pytest.approx(orders.log_determinant(dense, values).tolist())
    assert values_of(orders.o_five(entries)(df, names)) == pytest.approx([float(values[:, k] @ dense @ values[:, k]) for k in range(6)])
    scores = graphs.pca_features(both, ["x", "y", "z"], 2).orderBy("pid").select("pc0", "pc1").toPandas().to_numpy()
    signs = np.where(vt[:2].T >= 0, 1.0, -1.0)
    assert scores == pytest.approx(a @ (signs * signs[:1]))
    sides = graphs.pca_features(both, ["x", "y", "z"], 2, use_j=True).orderBy("pid").select("pc0", "pc1").toPandas().to_numpy()
    left = np.where(u[:, :2] >= 0, 1, -1)
    assert (sides == left * left[:1]).all()
    m = a.T @ a + np.eye(3)
    f = np.array([[1], [1], [-1]])
    assert orders.log_determinant(m, f)[0] == pytest.approx(np.linalg.slogdet(m[:2, :2])[1] + math.log(m[2, 2]))
    d = orders.minkowski(table(spark, [[0.0, 0.0], [3.0, 4.0]], ["x", "y"]), ["x", "y"])
    assert d.first()["d"] == 5 and orders.linear_similarity(d, 10).first()["w"] == 0.5


# -- entropies and scaling -------------------------------------------------------------------
def test_entropies(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2)], "a int, b int")
    assert {r["col"]: r["value"] for r in entropy.entropies(df, ["a"]).collect()}["a"] == pytest.approx(math.log(2))
    assert entropy.joint_entropy(df, ["a", "b"]).first()["value"] == pytest.approx(math.log(2))
    assert entropy.joint_entropy(df.limit(0), ["a"]).first()["value"] == 0
    assert entropy.pairwise_mutual_information(df, ["a", "b"]).first()["value"] == pytest.approx(math.log(2))
    assert entropy.split_information(df, [(["a"], ["b"])]) == pytest.approx([math.log(2)])
    assert entropy.split_information(df, [(["a"], ["b"])], joint=False) == pytest.approx([math.log(2)])


def test_exact_quantiles(spark):
    from sidewise.functions import ordering

    r = np.random.default_rng(2)
    columns = {"a": r.normal(size=3001) ** 3 * 1e6, "b": r.integers(0, 3, 3001).astype(float), "c": np.full(3001, 7.0)}
    rows = [(k, *[None if k % 10 == 0 else float(v[k]) for v in columns.values()], float("inf") if k > 2000 else float(k), None) for k in range(3001)]
    df = spark.createDataFrame(rows, "pid long, a double, b double, c double, i double, n double").repartition(5)
    kept = np.arange(3001) % 10 != 0
    for q in (0.0, 0.25, 0.5, 0.999, 1.0):
        found = ordering.quantiles(df, ["a", "b", "c", "n"], q)
        assert found["n"] is None
        for c, v in columns.items():
            assert found[c] == pytest.approx(np.quantile(v[kept], q))
    assert ordering.quantiles(df, ["i"])["i"] == 1500
    numbered = {x["pid"]: x["k"] for x in ordering.numbered(df, ["pid"], "k").collect()}
    assert numbered == {k: k for k in range(3001)}


def test_scaling(spark):
    df = table(spark, [[1.0, 656.0], [3.0, 100.0]], ["a", "b"])
    rows = lambda x: [(r["a"], r["b"]) for r in x.orderBy("pid").collect()]
    assert rows(scaling.standardize(df, ["a", "b"])) == [(-1, 1), (1, -1)]
    assert rows(scaling.standardize(df.withColumn("a", F.lit(2.0)), ["a", "b"])) == [(0, 1), (0, -1)]
    three = table(spark, [[0.0, -1.0], [1.0, 1.0], [100.0, -1.0]], ["a", "b"])
    assert rows(scaling.balance(three, ["a", "b"])) == [(-1, 0), (0, 2), (99, 0)]
    assert rows(scaling.unit_rows(table(spark, [[3.0, 4.0], [0.0, 0.0]], ["a", "b"]), ["a", "b"])) == [(0.6, 0.8), (None, None)]
    assert rows(scaling.balance_rows(df, ["a", "b"]))[0] == (-327.5, 327.5)


def test_scaling_of_rows(spark):
    x = np.random.default_rng(0).random((6, 3)) * [50, 10, 8]
    df = table(spark, x.tolist(), list("abc"))
    rows = lambda d: d.orderBy("pid").select(*"abc").toPandas().to_numpy()
    assert rows(scaling.standardize_rows(df, list("abc"))) == pytest.approx((x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True))
    assert rows(scaling.balance_rows(df, list("abc"))) == pytest.approx(x - np.median(x, axis=1, keepdims=True))
    assert rows(scaling.unit_rows(df, list("abc"))) == pytest.approx(x / np.linalg.norm(x, axis=1, keepdims=True))


# -- analysis --------------------------------------------------------------------------------
def test_visibility():
    m = np.array([[1, 1, 1, 0], [1, -1, 0, 0], [-1, 1, 1, 1]], np.int8)
    assert analysis.coherence_levels(m).tolist() == [3, 2, -1]
    assert analysis.complexity_levels(m).tolist() == [1, 1, 0]
    assert analysis.visibility(m, np.arange(4.0)).tolist() == [2, 1, 3]
    assert analysis.without_prefixes(np.array([[1, 0], [1, 1], [-1, 0]])).tolist() == [[1, 1], [-1, 0]]


def test_soft_clusters(spark):
    m = np.array([[1, 1, 1, -1, 1, 0], [-1, -1, 1, 1, -1, -1], [-1, -1, -1, 1, -1, 1]], np.int8)
    names = [f"f{i}" for i in range(6)]
    df = table(spark, [[1] * 6], names)
    assert tuple(df.select(*analysis.soft_clusters(m, names)).first()) == pytest.approx((0.75, 0.125, 0.125))
    assert tuple(df.select(*analysis.hard_clusters(m, names)).first()) == (1, 0, 0)


def test_clusters_of_rows_on_both_sides(spark):
    m = np.array([[1, 1, 1, -1, 1, 0], [-1, -1, 1, 1, -1, -1], [-1, -1, -1, 1, -1, 1]], np.int8)
    names = [f"f{i}" for i in range(6)]
    rows = [[0] * 6, [1, 0, -1, 0, 1, 1], [-1, 1, 0, 1, 0, 0], [0, -1, 1, -1, 1, -1]]

    # The first accord parts from the others at f0, along with f1, f3 (turned) and f4; those two
    # part at f2, along with f5 (turned).
    share = lambda f, columns: sum((f[c] * s + 1) / 2 for c, s in columns) / len(columns)
    soft_p = [(share(f, [(0, 1), (1, 1), (3, -1), (4, 1)]), share(f, [(2, 1), (5, -1)])) for f in rows]
    hard_p = [(float(f[0] > 0), float(f[2] > 0)) for f in rows]
    df = table(spark, rows, names).orderBy("pid")
    for parts, columns in ((soft_p, analysis.soft_clusters(m, names)), (hard_p, analysis.hard_clusters(m, names))):
        for (p, q), r in zip(parts, df.select(*columns).collect(), strict=True):
            assert list(r) == pytest.approx([p, (1 - p) * q, (1 - p) * (1 - q)])


def test_scores(spark, random_sides):
    _, names, df = random_sides
    accords = spark.createDataFrame([(0, 0, 1), (0, 1, -1), (1, 0, -1)], "accord int, feature int, side int")
    out = analysis.accord_scores(df, names, accords)
    sums = out.groupBy("pid").agg(F.sum("score").alias("s"), F.min("score").alias("m")).collect()
    assert all(r["m"] == 0 and (r["s"] == pytest.approx(1) or r["s"] == 0) for r in sums)
    with pytest.raises(ValueError, match="refer"):
        analysis.accord_scores(df, names, spark.createDataFrame([(0, 9, 1)], "accord int, feature int, side int"))
    both = analysis.accord_scores(df, names, accords, True, True).groupBy("accord").agg(F.min("score").alias("m"), F.sum("score").alias("s")).collect()
    assert all(r["m"] == pytest.approx(0) and r["s"] == pytest.approx(1) for r in both)
    assert analysis.accord_scores(df, names, accords.limit(0)).count() == 0
    assert analysis.location_size(df, [("f0", 1), ("f1", 1)]) == df.where("f0 = 1 AND f1 = 1").count()


# -- intervals and logic ---------------------------------------------------------------------
def test_intervals(spark):
    a, b = IntervalUnion.of(1, 2), IntervalUnion.of(1.5, 3, True, True)
    assert str(~a) == "(-inf, 1] u [2, inf)"
    assert ~~a == a and (~IntervalUnion()).is_empty() and (IntervalUnion.of(2, 2)).is_empty()
    r = random.Random(0)
    unions = [a, b, a | b, a & b, a - b, a ^ b, ~b]
    for _ in range(200):
        x = r.choice([r.uniform(0, 4), 1, 1.5, 2, 3])
        assert (x in (a | b)) == (x in a or x in b) and (x in (a & b)) == (x in a and x in b)
        assert (x in (a - b)) == (x in a and x not in b) and (x in (a ^ b)) == ((x in a) != (x in b))
    assert ~(a | b) == ~a & ~b
    xs = [0.0, 1.0, 1.5, 1.7, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for u in unions:
        assert [r[0] for r in df.select(u.column(F.col("x"))).collect()] == [x in u for x in xs]


def test_logic():
    r = random.Random(1)
    for _ in range(100):
        arrays = [np.array([[r.choice([-1, 0, 1]) for _ in range(3)] for _ in range(4)]) for _ in range(2)]
        s, t = logic.Term.of(arrays[0]), logic.Term.of(arrays[1])
        for _ in range(10):
            x = [r.choice([-1, 1]) for _ in range(4)]
            plain = any(all(c[v] in (0, x[v]) for v in range(4)) for c in arrays[0].T)
            assert s.value(x) == plain == s.other().value(x)
            assert (s & t).value(x) == (plain and t.value(x)) and (s | t).value(x) == (plain or t.value(x))
            assert (~s).value(x) != plain
    assert logic.Term.of(np.array([[1, -1], [0, 1]])).text(["a", "b"]) in ("(not a and b) or a", "a or b", "a or (not a and b)")
    term = logic.corner_term(2, -1, {2: ((0, 1), (1, -1))})
    assert term.clauses == {frozenset({(0, -1)}), frozenset({(1, 1)})}


# -- graphs ----------------------------------------------------------------------------------
def test_graphs(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 2.0), (3, 2, 2.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(9,)], "node long")
    assert {r["node"]: r["component"] for r in graphs.connected_components(edges, nodes).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 9: 9}
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, w double")
    assert graphs.connected_components(chain).select("component").distinct().count() == 1
    values = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, -1.0), (3, 1.0)], "node long, x double")
    domains = {(r["node"], r["side"]): r["domain"] for r in graphs.nodal_domains(edges, values).collect()}
    assert domains == {(2, -1): 2, (0, 1): 0, (1, 1): 0, (3, 1): 3}
    assert graphs.greedy_neighbourhood(graphs.both_ways(chain), [5], 4, take=1) == [5, 4, 3, 2]
    assert graphs.min_cut([(0, 1, 3), (1, 0, 3), (1, 2, 1), (2, 1, 1), (2, 3, 3), (3, 2, 3)], 4, [0], [3]).tolist() == [-1, -1, 1, 1]
    line = table(spark, [[[0.0]], [[1.0]], [[1.0]], [[5.0]]], ["v"])
    assert {(r["src"], r["dst"]) for r in graphs.knn_graph(line, "v", 1).collect()} == {(0, 1), (1, 2), (2, 1), (3, 1)}
    assert graphs.knn_graph(line, "v", 1, ties_all=True).count() == 6
    d = graphs.distances(line, "v")
    knn = {(r["src"], r["dst"]) for r in graphs.nearest_neighbours(d, 1).collect()}
    assert knn == {(0, 1), (1, 2), (2, 1), (3, 1)}
    assert graphs.nearest_neighbours(d, 1, ties_all=True).count() == 6
    assert graphs.epsilon_graph(d, 1.0).count() == 2
    entries = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0)], "pid long, term string, x double")
    assert graphs.sparse_cosine(entries).first()["w"] == pytest.approx(2**-0.5)
    r = np.random.default_rng(4)
    dense = np.where(r.random((40, 12)) < 0.3, r.normal(size=(40, 12)), 0)
    dense[:, 0] = 1
    entries = spark.createDataFrame([(i, f"t{j}", float(dense[i, j])) for i in range(40) for j in range(12) if dense[i, j]], "pid long, term string, x double")
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    for least in (0.25, 0.6, 0.95):
        want = {(i, j): float(unit[i] @ unit[j]) for i in range(40) for j in range(40) if i != j and unit[i] @ unit[j] >= least}
        found = {(r["src"], r["dst"]): r["w"] for r in graphs.sparse_cosine(entries, least).collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    grid = generators.grid_graph(spark, (2, 2), 1)
    pixels = spark.createDataFrame([(0, 0), (1, 0), (2, 9), (3, 9)], "pixel_id long, g int")
    w = {(r["src"], r["dst"]): r["w"] for r in graphs.image_graph(grid, pixels, ["g"], 1, 1).collect()}
    assert w[0, 1] == 1 and w[0, 2] == pytest.approx(math.exp(-1))
    signs = graphs.spectral_features(np.array([[1, -1, 0], [-1, 2, -1], [0, -1, 1.0]]), 2)
    assert signs[:, 0].tolist() == [1, 1, 1] and signs[0, 1] == 1 and signs[2, 1] == -1
    found = graphs.spectral_features_by_component(edges, 4)
    assert found.where("v = 1").groupBy("feature").count().count() >= 2


def test_lanczos_and_domains(spark):
    n = 9
    a = np.zeros((n, n))
    for i, j in [(k, k + 1) for k in range(n - 1)] + [(0, 3), (4, 8)]:
        a[i, j] = a[j, i] = 1 + (i + j) % 3
    lap = np.diag(a.sum(axis=1)) - a
    entries = spark.createDataFrame([(i, j, float(lap[i, j])) for i in range(n) for j in range(n) if lap[i, j]], "src long, dst long, w double").coalesce(1)
    found = graphs.spectral_features_of_graph(entries, 3, steps=n).orderBy("node").select("f0", "f1", "f2").toPandas().to_numpy()
    assert (found == graphs.spectral_features(lap, 3)).all()
    two = spark.createDataFrame([(0, -1, 0), (1, -1, 0), (2, 1, 2)], "node long, side int, domain long")
    assert sorted(tuple(r) for r in graphs.domain_features(two).collect()) == [("-1:0", 0), ("-1:0", 1)]
    three = two.union(spark.createDataFrame([(3, 1, 3)], two.schema))
    assert graphs.domain_features(three).select("feature").distinct().count() == 3


def test_png(spark, tmp_path):
    import struct
    import zlib

    def png(pixels, rules, colour, palette=b""):
        h, w, n = pixels.shape
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        x = np.zeros((h + 1, w + 1, n), int)
        x[1:, 1:] = pixels
        lines = []
        for r in range(1, h + 1):
            rule, line = rules[r % len(rules)], []
            for c in range(1, w + 1):
                left, up, corner = x[r, c - 1], x[r - 1, c], x[r - 1, c - 1]
                near = [min((left[k], up[k], corner[k]), key=lambda v, k=k: abs(int(v) - int(left[k] + up[k] - corner[k]))) for k in range(n)]  # noqa: B023
                guess = [0 * left, left, up, (left + up) // 2, np.array(near)][rule]
                line += ((x[r, c] - guess) % 256).tolist()
            lines.append(bytes([rule, *line]))
        head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
        parts = [chunk(b"IHDR", head), chunk(b"PLTE", palette) if palette else b"", chunk(b"IDAT", zlib.compress(b"".join(lines))), chunk(b"IEND", b"")]
        return bytes([137, 80, 78, 71, 13, 10, 26, 10]) + b"".join(parts)

    r = np.random.default_rng(1)
    for name, n, colour in (("grey", 1, 0), ("rgb", 3, 2), ("rgba", 4, 6)):
        pixels = r.integers(0, 256, (7, 5, n))
        (tmp_path / f"{name}.png").write_bytes(png(pixels, [0, 1, 2, 3, 4], colour))
        assert (files.decode_png((tmp_path / f"{name}.png").read_bytes()) == pixels).all()
    palette = r.integers(0, 256, (4, 3)).astype(np.uint8)
    pixels = r.integers(0, 4, (3, 3, 1))
    assert (files.decode_png(png(pixels, [0], 3, palette.tobytes())) == palette[pixels[:, :, 0]]).all()
    found = files.read_pixels(spark, str(tmp_path / "rgb.png")).orderBy("pixel_id").collect()
    want = files.decode_png((tmp_path / "rgb.png").read_bytes())
    assert [(x["row"], x["col"], x["samples"]) for x in found] == [(i, j, want[i, j].tolist()) for i in range(7) for j in range(5)]


# -- surveys ---------------------------------------------------------------------------------
@pytest.fixture
def survey(spark):
    rows = [(i, ["x", "y", "z", "?"][i % 4], i % 5, float(i) if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "pid long, nom string, ord int, num double")
    variables = {
        "nom": files.Variable("nom", "nominal", "Name", {"x": "X", "y": "Y", "z": "Z"}, {"?": "none"}),
        "ord": files.Variable("ord", "ordinal", "", {k: str(k) for k in range(1, 5)}, {0: "zero"}),
        "num": files.Variable("num", "numeric"),
    }
    return surveys.Survey(df, variables)


def test_survey_selection_and_summaries(survey, tmp_path, spark):
    assert survey.select([True, False, True]) == ["nom", "num"] and survey.select(1) == ["ord"]
    assert survey.select(lambda v: v.type == "ordinal") == ["ord"] and survey.select(slice(1, None)) == ["ord", "num"]
    assert survey.select_questions("ord").columns == ["ord"]
    assert survey.df.where(survey.complete()).count() == sum(1 for i in range(40) if i % 4 != 3 and i % 5 and i % 7)
    info = {r["variable"]: r["num_valid_answers"] for r in survey.variable_info().collect()}
    assert info == {"nom": 30, "ord": 32, "num": 34}
    summary = {r["variable"]: r for r in survey.summarize().collect()}
    assert summary["ord"]["min"] == 1 and summary["ord"]["max"] == 4 and summary["nom"]["min"] is None
    assert survey.unique_answers("nom") == 4
    assert {(r["variable"], r["value"]): r["n"] for r in survey.value_counts("nom").collect()} == {("nom", c): 10 for c in "xyz"}
    _, wrong = survey.check()
    assert wrong == {}
    _, wrong = survey.set_values("nom", {"x": "X", "y": "Y"}).check()
    assert "z" in wrong["nom"]
    files.save(survey.df, survey.variables, str(tmp_path), "s")
    data, back = files.load(spark, str(tmp_path), "s")
    assert data.count() == 40 and back["ord"].valid == survey.variables["ord"].valid
    whole = survey.nulls_to_sentinels()
    assert whole.df.where("num IS NULL").count() == 0 and list(whole.variables["num"].invalid) == [-1.0]


def test_survey_edits(survey):
    edited = survey.replace_values("nom").df
    assert edited.where("nom = -1").count() == 10 and edited.where("nom = 3").count() == 10
    merged = survey.replace_values("ord", {3: 2, 4: 2})
    assert merged.variables["ord"].valid == {1: "1", 2: "2 | 3 | 4"} and merged.df.where("ord = 2").count() == 24
    assert survey.replace_values("nom", ["z", "y", "x", "?"]).df.where("nom = 1").count() == 10
    assert survey.rename({"nom": "name"}).columns == ["name", "ord", "num"]
    assert survey.labelled("nom").columns == ["pid", "Name"]
    guessed = surveys.Survey(survey.df).guess_types().guess_value_lists("ord", IntervalUnion.of(-INF, 0, False, True))
    assert guessed.variables["num"].type == "ordinal" and guessed.variables["nom"].type == "nominal"
    assert list(guessed.variables["ord"].invalid) == [0]
    assert survey.resample("nom", 7).df.groupBy("nom").count().where("count = 7").count() == 4
    with pytest.raises(ValueError, match="ranges"):
        survey.resample("num")
    assert survey.resample("num", 5, [IntervalUnion.of(0, 10), IntervalUnion.of(20, 30)]).df.count() == 10
    spss = files.from_labelled_file(["a"], {"a": "A"}, {"a": "scale"}, {"a": {1: "one", 99: "no"}}, {"a": [(90, 100)]})
    assert spss["a"].type == "numeric" and spss["a"].invalid == {99: "no"}


def test_features_mean_what_they_say(survey):
    for invalid in ("ignore", "both", "own", "implicit"):
        found = survey.features(invalid=invalid, num_bins=4, max_extensive=3)
        rows = survey.df.select("*", *[f.column.alias(f"x{i}") for i, f in enumerate(found)]).collect()
        for i, f in enumerate(found):
            c, op, v = f.info
            bad = set(survey.variables[c].invalid)
            for r in rows:
                x = r[c]
                if op == "invalid":
                    want = 1 if x is None or x in bad else -1
                elif invalid == "both" and (x is None or x in bad):
                    want = 0
                else:
                    holds = x is not None and (x == v if op == "==" else x >= v if op == ">=" else v[0] <= x < v[1] or v[3] and x == v[1])
                    want = 1 if holds else -1
                assert r[f"x{i}"] == want, (invalid, f.name, x)
    with pytest.raises(ValueError, match="two values"):
        features.binary_values("a", [1, 2, 3])


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 16)
    r = np.random.default_rng(6)
    x = r.integers(-9, 10, (90, 5)).astype(float)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "pid long, v array<double>").repartition(4)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for metric, want in (("euclidean", far), ("cityblock", np.abs(x[:, None] - x[None]).sum(axis=2)), ("hamming", (x[:, None] != x[None]).mean(axis=2))):
        found = {(r["src"] // 3, r["dst"] // 3): r["d"] for r in graphs.distances(df, "v", metric).collect()}
        assert len(found) == 90 * 89 and all(found[i, j] == pytest.approx(want[i, j]) for i, j in found)
    for k in (1, 4):
        want = {(i, j) for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (far[i, j], j))[:k]}
        assert {(r["src"] // 3, r["dst"] // 3) for r in graphs.knn_graph(df, "v", k).collect()} == want
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r["src"] // 3, r["dst"] // 3): r["w"] for r in graphs.cosine_similarity(df, "v", 0.6).collect()}
    want = {(i, j): unit[i] @ unit[j] for i in range(90) for j in range(90) if i != j and unit[i] @ unit[j] >= 0.6}
    assert found.keys() == want.keys() and all(found[p] == pytest.approx(w) for p, w in want.items())


def test_respondents_by_mask_ids_and_function(survey):
    mask = [k % 3 == 0 for k in range(40)]
    assert sorted(r["pid"] for r in survey.select_respondents(mask).df.collect()) == list(range(0, 40, 3))
    assert sorted(r["pid"] for r in survey.select_respondents(np.array([3, 5])).df.collect()) == [3, 5]
    assert sorted(r["pid"] for r in survey.select_respondents(lambda row: row["nom"] == "x" and row["ord"] == 0).df.collect()) == [0, 20]
    assert survey.select_respondents(F.col("pid") < 4).df.count() == 4 and survey.select_respondents([]).df.count() == 0
    with pytest.raises(ValueError, match="marks"):
        survey.select_respondents([True, False])
    with pytest.raises(ValueError, match="more than 3 values"):
        features.distinct_values(survey.df, "pid", most=3)


def test_survey_searches_with_options(survey, spark):
    own = [features.Feature("low", features.side(F.col("ord") <= 2), ("ord", "<=", 2)), features.Feature("x", features.side(F.col("nom") == "x"), ("nom", "==", "x"))]
    found = surveys.SurveyAccords(survey, 5, features=own, order=[1, 0])
    assert found.search.tree.features == [1, 0] and found.specified() == [1, 0]
    assert [tuple(r) for r in found.metadata_table().collect()] == [(0, 1, "nom", "==", "x"), (1, 0, "ord", "<=", "2")]
    assert surveys.SurveyAccords(survey, 5, factory=lambda s: own, order=None).search.tree.features == [0, 1]
    graph = surveys.SurveyAccords(survey, 5, features=own, order="cut")
    cuts = values_of(orders.cut_weight(graph.similarity, graph.table, graph.names))
    assert graph.search.tree.features == sorted(range(2), key=lambda k: (cuts[k], k))
    nested = surveys.SurveyAccords(survey, 4, features=own, order="O1", uncross=True)
    assert nested.matrix().shape[1] == len(nested.levels()) and set(nested.levels()) <= {0, 1}
    with pytest.raises(ValueError, match="order function"):
        surveys.SurveyAccords(survey, 4, features=own, order=[0, 1], uncross=True)
    found = surveys.SurveyAccords(survey, 5, features=own, order=None)
    with pytest.raises(ValueError, match="resumed"):
        found.change_agreement(0, force=False)
    answers, const = found.typical_answers(extract_const=True)
    assert all(set(const).isdisjoint(a) for a in answers)
    merged = [{**a, **const} for a in answers]
    assert merged == found.typical_answers()
    assert all(set(a) == {"ord"} for a in found.typical_answers(selection="ord"))
    m = found.matrix()
    assert len(found.typical_answers(only_max_level=True)) == int((m[:, -1] != 0).sum())
    assert any(k.startswith("Name[") for a in found.typical_answers(labels=True) for k in a)
    v = survey.variables["nom"]
    assert v.set_values({"x": "X"}, {"x": "no", "y": "Y"}).invalid == {"y": "Y"} and v.all_values() == ["x", "y", "z", "?"]
    assert v.allows("==") and not v.allows("<") and survey.variables["num"].allows("in")
    assert v.replace_values({"y": "x"}).valid == {"x": "X | Y", "z": "Z"} and v.row()[0] == "nom"


def test_typical_answers(survey, tmp_path):
    found = surveys.SurveyAccords(survey, 5)
    assert found.typical_answers() and len(found.metadata()) == len(found.search.tree.features)
    before = len(found.matrix())
    found.change_agreement(3)
    assert len(found.matrix()) >= before and len(found.matrix(remove_prefixes=True)) <= len(found.matrix())
    found.save(str(tmp_path / "accords"))
    back = surveys.SurveyAccords.load(survey, str(tmp_path / "accords"))
    assert back.typical_answers() == found.typical_answers() and back.metadata() == found.metadata()
    v = survey.variables
    assert surveys.possible_values(v["ord"], [(">=", 2), ("!=", 3)]) == {2, 4}
    assert surveys.possible_values(v["nom"], [("!=", "x"), ("==", "x")]) == {"x"}
    assert str(surveys.possible_values(v["num"], [(">=", 1), ("<", 4)])) == "[1, 4)"
    a, b = (features.Feature(n, F.col(n), (n, "==", 1)) for n in "ab")
    corner = corners.corners(a, b)[3]
    known = {f.name: f for f in (a, b)}
    assert surveys.explain(corner, 1, known) == [[("a", "==", 1), ("b", "==", 1)]]
    assert surveys.explain(corner, -1, known) == [[("a", "!=", 1)], [("b", "!=", 1)]]


# -- streams, generators, catalog ------------------------------------------------------------
def test_streamed_atoms(spark, tmp_path):
    df = generators.random_features(spark, 3, 500, 0.3, seed=4)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.maintain(stream, ["f0", "f1", "f2"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in streams.current(spark, ["f0", "f1", "f2"], str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in counts.atoms(df, ["f0", "f1", "f2"]).collect()}
    assert 0.2 < df.where("f0 = 1").count() / 500 < 0.4


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_catalog_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(catalog.SQL[name])
    found = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert plain(found.select(*want.columns).collect()) == plain(want.fetchall())


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_minimize_order_limit(spark):
    from sidewise.operators import graphs

    pairs = [(i, j) for i in range(5) for j in range(5) if i != j]
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "src long, dst long, w double")
    points = spark.createDataFrame([(i, 1 if i < 3 else -1) for i in range(5)], "pid long, c int")
    with pytest.raises(RuntimeError, match="1 flips"):  # two are needed
        graphs.minimize_order(edges, points, "c", 1)
    for limit in ({"max_steps": 2}, {}):
        assert {r["c"] for r in graphs.minimize_order(edges, points, "c", **limit).collect()} == {1}


def test_modularity_everywhere(spark):
    from sidewise.operators import graphs

    a = np.array([[0, 1, 2, 0], [1, 0, 0, 0], [2, 0, 0, 0], [0, 0, 0, 0]], float)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "src long, dst long, w double")
    places = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "src long, dst long")
    want = a - np.outer(a.sum(axis=1), a.sum(axis=1)) / a.sum()
    found = {(r["src"], r["dst"]): r["w"] for r in graphs.modularity_at(edges, places).collect()}
    assert len(found) == 16 and all(found[i, j] == pytest.approx(want[i, j]) for i, j in found)


def test_ratio_derivative_of_many_rows(spark):
    """Products of side sizes exceed 32 bits."""
    points = spark.range(100_000).select(F.col("id").alias("pid"), F.when(F.col("id") < 50_000, 1).otherwise(-1).alias("f"))
    edges = graphs.both_ways(spark.createDataFrame([(0, 99_999, 1.0)], "src long, dst long, w double"))
    got = {r["pid"]: r["change"] for r in orders.discrete_derivative(edges, points, "f", kind="ratio").where("pid < 2").collect()}
    assert got[0] == pytest.approx(-1e5 / 5e4**2) and got[1] == pytest.approx(1e5 / (49_999 * 50_001) - 1e5 / 5e4**2)


def test_determinant_of_a_large_block_of_small_parts(spark):
    """A side of 20,000 rows, whose matrix as a whole would take 3.2 GB."""
    points = spark.range(20_000).select(F.col("id").alias("pid"), F.lit(1).alias("f"))
    own = points.select(F.col("pid").alias("src"), F.col("pid").alias("dst"), F.lit(2.0).alias("w"))
    pair = points.where("pid < 2").select(F.col("pid").alias("src"), (1 - F.col("pid")).alias("dst"), F.lit(1.0).alias("w"))
    got = orders.log_determinant_order(own.union(pair), points, ["f"]).collect()
    assert [r["feature"] for r in got] == [0] and got[0]["value"] == pytest.approx(19_998 * math.log(2) + math.log(3))


def test_components_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PART_EDGES", 4)
    chain = [(i, i + 1, 1.0) for i in range(0, 40) if i != 20]
    edges = spark.createDataFrame([*chain, *chain, (7, 7, 1.0), (50, 50, 1.0), (60, 61, 0.0)], "src long, dst long, w double")
    want = {i: 0 if i <= 20 else 21 for i in range(41)} | {50: 50}
    assert {r["node"]: r["component"] for r in graphs.connected_components(edges).collect()} == want


def _counted_edges(spark, rows):
    """A table of edges and how many of its rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "src long, dst long, w double"), made


def test_graph_is_made_once(spark):
    edges, made = _counted_edges(spark, [(a, b, 1.0) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))])
    assert graphs.greedy_neighbourhood(edges, [5], 4, take=1) == [5, 4, 3, 2] and made.value == 18


def test_domains_make_the_graph_once(spark):
    edges, made = _counted_edges(spark, [(a, b, 1.0) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))])
    values = spark.createDataFrame([(i, -1.0 if 3 <= i < 6 else 0.0 if i == 9 else 1.0) for i in range(10)], "node long, x double")
    want = {"strong": {(6, 1, 6), (0, 1, 0), (3, -1, 3)}, "decomposition": {(6, 1, 6), (9, 1, 6), (3, -1, 3)}, "weak": {(9, 1, 6), (9, -1, 9), (3, -1, 3)}}
    for kind, some in want.items():
        made.value = 0
        got = {tuple(r) for r in graphs.nodal_domains(edges, values, kind).collect()}
        assert some <= got and made.value == 18


def test_pairs_over_groups(spark, monkeypatch):
    """Few partitions or one: the pairs are dealt to tasks all the same; ties and copies count."""
    monkeypatch.setattr(graphs, "BLOCK", 8)
    r = np.random.default_rng(7)
    x = r.integers(-1, 2, (150, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, v array<double>").coalesce(1)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert graphs.distances(df, "v", max_dist=1.2).rdd.getNumPartitions() > 1
    near = {(i, j) for i in range(150) for j in range(150) if i != j and far[i, j] < 1.2}
    assert {(e["src"], e["dst"]) for e in graphs.distances(df, "v", max_dist=1.2).collect()} == near
    for ties in (False, True):
        want = set()
        for i in range(150):
            order = sorted((far[i, j], j) for j in range(150) if j != i)
            want |= {(i, j) for d, j in (order if ties else order[:4]) if d <= order[3][0]}
        assert {(e["src"], e["dst"]) for e in graphs.knn_graph(df, "v", 4, ties_all=ties).collect()} == want


@pytest.mark.parametrize("least, strict", [(0, False), (1, True), (2, False), (2, True), (3, True)])
def test_equal_coordinates_of_pairs(spark, least, strict):
    r = np.random.default_rng(8)
    x = r.integers(0, 3, (70, 3)).tolist()
    cells = [[None if v == 0 else v for v in row] for row in x]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(cells)], "pid long, a int, b int, c int")
    found = {(e["src"], e["dst"]): e["w"] for e in graphs.hamming_similarity(df, ["a", "b", "c"], least, strict).collect()}
    same = {(i, j): float(sum(p == q for p, q in zip(x[i], x[j], strict=True))) for i in range(70) for j in range(70) if i != j}
    assert found == {k: w for k, w in same.items() if (w > least if strict else w >= least)}
    assert (least, strict) == (3, True) or graphs.hamming_similarity(df, ["a", "b", "c"], least, strict).rdd.getNumPartitions() > 1


def test_corners_are_told_apart_by_distinct_rows(spark, monkeypatch):
    seen, identify = [], corners.identify
    monkeypatch.setattr(corners, "identify", lambda df, *a: seen.append(df.count()) or identify(df, *a))
    df = spark.range(1000).select(F.col("id").alias("pid"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(-1).alias("b"))
    found = corners.with_corners(df, [features.Feature(n, F.col(n)) for n in "ab"])
    assert len(found) == 6 and seen == [4]


def test_resample_of_a_large_stratum(spark, tmp_path):
    """400 draws of two million rows need not repeat one; that draws do is told by enough of them."""
    rows = spark.range(2_000_000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit("2-HIGH").alias("o_orderpriority"), (F.col("id") % 1000).cast("double").alias("o_totalprice"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in driver.queries()["resample"](spark, str(tmp_path)).collect()] == [("F", 400, True, True, True)]


def test_spectral_features_of_components_together(spark):
    """Paths of several sizes, more than a batch: as one by one."""
    rows, at, want = [], 0, {}
    for k in range(60):
        n = 2 + k % 4
        a = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        rows += [(at + i, at + i + 1, 1.0) for i in range(n - 1)]
        want |= {(f"{at}:0", at + i): int(s) for i, s in enumerate(graphs.spectral_features(np.diag(a.sum(axis=1)) - a, 2)[:, 1])}
        at += n
    edges = graphs.both_ways(spark.createDataFrame(rows, "src long, dst long, w double"))
    got = {(r["feature"], r["node"]): r["v"] for r in graphs.spectral_features_by_component(edges, 1, ignore_small=False).collect() if ":" in r["feature"]}
    assert got == want
