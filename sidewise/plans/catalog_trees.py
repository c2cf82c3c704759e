"""Queries on search trees, orders of features, and what accords say about rows."""
# ruff: noqa: ANN001, ANN201

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import entropy, logic
from ..operators import analysis, corners, counts, features, orders, surveys
from ..sources.storage import shared_folder
from . import search as plans
from .catalog import (
    _H,
    _ITEMS,
    _ORDERS,
    _PATH,
    CONDITIONS,
    ITEMS,
    LONG,
    NAMES,
    SHARE,
    _bound,
    _searched,
    _text,
    _tree_sql,
    item_survey,
    items,
    order_columns,
    query,
    read,
)
from .tree import AccordTree, Node, problems

_NODES = f"{_tree_sql()} SELECT level, {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement FROM nodes"
_MAXIMAL = (
    f"{_tree_sql()}, mx AS (SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.level = n.level + 1 AND c.path[1:n.level] = n.path))"
)
_NODE = "level int, path string, agreement long"


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _nodes(spark, tree: AccordTree, bound: float):
    return spark.createDataFrame([(n.level, _text(n.path), int(n.agreement)) for n in tree.root.walk() if n.agreement >= bound], _NODE)


# -- trees -----------------------------------------------------------------------------------
@query("tree_saved", _NODES)
def tree_saved(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    folder = _folder(spark, "tree")
    found.tree.save(spark, folder)
    return _nodes(spark, AccordTree.load(spark, folder), a)


@query("tree_inserted", _NODES)
def tree_inserted(spark, sf_dir):
    """Every other feature appended, the rest inserted between."""
    df = items(spark, sf_dir)
    a = _bound(df)
    found = plans.Search(df, NAMES)
    for f in (0, 2, 4):
        found.sweep.append(f, a)
    for at, f in ((1, 1), (3, 3), (5, 5)):
        found.sweep.insert(at, f, a)
    return _nodes(spark, found.tree, a)


def _beam_sql(width: int) -> str:
    """The search's steps from the nodes of largest agreement only."""
    out = _tree_sql()
    for k in range(1, 6):
        best = f"(SELECT * FROM p{k}, m WHERE p{k}.agreement >= m.a QUALIFY row_number() OVER (ORDER BY p{k}.agreement DESC, path) <= {width})"
        out = out.replace(f"FROM p{k} p, m,", f"FROM {best} p,").replace(f"[{2 * k}, {2 * k + 1}]) AS s) s WHERE p.agreement >= m.a)", f"[{2 * k}, {2 * k + 1}]) AS s) s)")
    return out


@query("greedy_beam", f"{_beam_sql(2)} SELECT {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement FROM nodes WHERE level = 6")
def greedy_beam(spark, sf_dir):
    df = items(spark, sf_dir)
    a = _bound(df)
    found = plans.Search(df, NAMES)
    found.tree.features.extend(range(6))
    return spark.createDataFrame([(_text(n.path), int(n.agreement)) for n in found.sweep.greedy(2, a)], "path string, agreement long")


@query("accord_matrix", f"{_MAXIMAL} SELECT rpad({_PATH}, 6, '0') AS row FROM mx")
def accord_matrix(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([("".join("-0+"[int(x) + 1] for x in row),) for row in found.matrix(a)], "row string")


@query(
    "splitting_levels",
    f"{_tree_sql()}, k AS (SELECT n.level, n.path, (SELECT count(*) FROM nodes c WHERE c.level = n.level + 1 AND c.path[1:n.level] = n.path) AS n FROM nodes n) "
    f"SELECT level, {_PATH} AS path, 'levels' AS kind FROM k WHERE level IN (SELECT level FROM k WHERE n <> 1) UNION ALL SELECT level, {_PATH}, 'nodes' FROM k WHERE n <> 1",
)
def splitting_levels(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    rows = [(n.level, _text(n.path), kind) for kind in ("levels", "nodes") for n in found.tree.maximal(a, include_splitting=kind)]
    return spark.createDataFrame(rows, "level int, path string, kind string")


@query(
    "pruned_tree",
    f"{_tree_sql()} SELECT level, count(*) AS n, true AS part FROM nodes, m WHERE agreement >= CAST(1.2 * m.a AS BIGINT) GROUP BY level",
)
def pruned_tree(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    small = found.tree.pruned(int(1.2 * a))
    sizes = [len(level) for level in small.levels()]
    return spark.createDataFrame([(k, n, small.is_part_of(found.tree)) for k, n in enumerate(sizes)], "level int, n long, part boolean")


@query("tree_height", f"{_tree_sql()} SELECT max(level) AS height, 0 AS above FROM nodes")
def tree_height(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(found.tree.height(a), found.tree.height(1 << 40))], "height int, above int")


@query(
    "tree_table",
    f"{_tree_sql()} SELECT level, CASE WHEN level = 0 THEN 0 WHEN path[level] % 2 = 1 THEN 1 ELSE -1 END AS side, count(*) AS n, CAST(sum(agreement) AS BIGINT) AS total FROM nodes GROUP BY 1, 2",
)
def tree_table(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    rows = found.tree.pruned(a).table(spark)
    return rows.groupBy("level", "side").agg(F.count("*").alias("n"), F.sum("agreement").cast("long").alias("total"))


@query("tree_layout", f"{_MAXIMAL} SELECT {_PATH} AS path, CAST(row_number() OVER (ORDER BY path) - 1 AS DOUBLE) AS x, CAST(-level AS DOUBLE) AS y FROM mx")
def tree_layout(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    tree = found.tree.pruned(a)
    paths = tree.table(spark).join(tree.layout(spark), "node", "left_semi").select("node", "path")
    parents = tree.layout(spark).select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = tree.layout(spark).join(parents, "node", "left_anti").join(paths, "node")
    return leaves.select(F.array_join(F.transform("path", lambda s: F.when(s > 0, "+").otherwise("-")), "").alias("path"), "x", "y")


@query("tree_of_paths", f"{_MAXIMAL} SELECT {_PATH} AS path FROM mx")
def tree_of_paths(spark, sf_dir):
    """A tree made of the matrix's rows has them as its leaves."""
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(_text(n.path),) for n in Node.from_paths(found.matrix(a)).leaves()], "path string")


@query("tree_problems", f"{_tree_sql()} SELECT count(*) AS nodes, 0 AS problems FROM nodes")
def tree_problems(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    tree = found.tree.pruned(a)
    return spark.createDataFrame([(sum(1 for _ in tree.root.walk()), len(problems(tree, found.counter, found.sweep.below)))], "nodes long, problems int")


@query(
    "search_progress",
    f"{_tree_sql()} SELECT 'append' AS event, level + 1 AS level, 2 * count(*) AS nodes FROM nodes WHERE level < 6 GROUP BY level",
)
def search_progress(spark, sf_dir):
    """What the listener is told: both sides of each node are made."""
    df, told = items(spark, sf_dir), []
    a = _bound(df)
    found = plans.Search(df, NAMES)
    found.sweep.progress = lambda event, **what: told.append((event, what["level"], what["nodes"]))
    for f in range(6):
        found.sweep.append(f, a)
    return spark.createDataFrame(told, "event string, level int, nodes long")


@query(
    "certificate",
    f"WITH {ITEMS} SELECT 1.0::DOUBLE AS covered, true AS reasons_hold, true AS on_path",
)
def certificate(spark, sf_dir):
    """Above the largest agreement of a whole path every leaf has a reason: together they cover
    all choices of sides, and each holds on the table."""
    df = items(spark, sf_dir)
    found, a = _searched(spark, sf_dir)
    top = int(max((n.agreement for n in found.tree.at_level(6, 1)), default=0)) + 1
    above = plans.search(df, NAMES, top)
    covered, hold, on_path = 0.0, True, True
    todo = [(plans.Certificate.create(above.sweep, top).irreducible(), frozenset())]
    while todo:
        c, chosen = todo.pop()
        todo += [(child, chosen | {(c.feature, s)}) for s, child in c.children.items()]
        if not c.children:
            covered += 2.0 ** -len(chosen)
            on_path &= c.reason <= chosen
            hold &= df.agg(counts.agreement(df, sorted((NAMES[f], s) for f, s in c.reason)).alias("n")).first()["n"] < top
    return spark.createDataFrame([(covered, hold, on_path)], "covered double, reasons_hold boolean, on_path boolean")


@query("counted_sets", f"WITH {ITEMS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS sides, count(*) FILTER (WHERE {cond}) AS n FROM f" for name, cond in (
        ("none", "true"), ("+0", "f0 > 0"), ("+0 -3", "f0 > 0 AND f3 < 0"), ("+0 -1 +2 -4", "f0 > 0 AND f1 < 0 AND f2 > 0 AND f4 < 0"), ("-1 -5", "f1 < 0 AND f5 < 0"))
))
def counted_sets(spark, sf_dir):
    counter = counts.Counter(items(spark, sf_dir), NAMES)
    sets = {"none": (), "+0": ((0, 1),), "+0 -3": ((0, 1), (3, -1)), "+0 -1 +2 -4": ((0, 1), (1, -1), (2, 1), (4, -1)), "-1 -5": ((1, -1), (5, -1))}
    counter.many([frozenset(s) for s in sets.values()])
    rows = [(name, int(counter(*s))) for name, s in sets.items()]
    counter.close()
    return spark.createDataFrame(rows, "sides string, n long")


# -- features and corners --------------------------------------------------------------------
def _sides(df, found):
    named = [f.named(f"x{i}") for i, f in enumerate(found)]
    sides = counts.side_counts(df.select(*[f.column.alias(f.name) for f in named]), [f.name for f in named])
    label = F.create_map(*[F.lit(x) for i, f in enumerate(found) for x in (f"x{i}", f.name)])
    return sides.select(label[F.col("feature")].alias("feature"), "positive", "ge_zero", "le_zero")


def _sides_sql(name: str, value: str, table: str) -> str:
    return f"SELECT '{name}' AS feature, count(*) FILTER (WHERE {value} > 0) AS positive, count(*) FILTER (WHERE {value} >= 0) AS ge_zero, count(*) FILTER (WHERE {value} <= 0) AS le_zero FROM {table}"


@query("feat_binary", _sides_sql("l_linestatus == O", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END", "lineitem"))
def feat_binary(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return _sides(df, features.binary_values("l_linestatus", features.distinct_values(df, "l_linestatus")))


@query(
    "feat_thresholds",
    " UNION ALL ".join((
        _sides_sql("subset", "CASE WHEN l_quantity - 25 > 0 THEN 1 ELSE -1 END", "lineitem"),
        _sides_sql("above", "CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END", "lineitem"),
        _sides_sql("from", "CASE WHEN l_discount >= 0.05 THEN 1 ELSE -1 END", "lineitem"),
    )),
)
def feat_thresholds(spark, sf_dir):
    made = {"subset": features.from_subset(F.col("l_quantity") - 25), "above": features.threshold(F.col("l_discount"), 0.05), "from": features.threshold(F.col("l_discount"), 0.05, False)}
    return _sides(read(spark, sf_dir, "lineitem"), [features.Feature(n, c) for n, c in made.items()])


@query("feature_table", f"SELECT CAST(sum(pid) AS BIGINT) AS ids, count(*) AS n, CAST(sum(f0) AS BIGINT) AS f0, CAST(sum(f4) AS BIGINT) AS f4 FROM (SELECT row_number() OVER () - 1 AS pid, {_ITEMS} FROM lineitem)")
def feature_table(spark, sf_dir):
    from .catalog import row_ids

    made = [features.Feature(n, features.side(F.expr(CONDITIONS[int(n[1])]))) for n in ("f0", "f4")]
    table = features.matrix(row_ids(read(spark, sf_dir, "lineitem")), made)
    return table.agg(F.sum("pid").alias("ids"), F.count("*").alias("n"), *[F.sum(n).alias(n) for n in ("f0", "f4")])


_PAIR_CORNERS = [(a, oa, b, ob) for a in range(3) for b in range(a + 1, 3) for oa, ob in corners.CORNERS]


def _corner_sql(only: bool) -> str:
    own = [] if only else [_sides_sql(f"f{k}", f"f{k}", "f") for k in range(3)]
    return f"WITH {ITEMS} " + " UNION ALL ".join([*own, *[_sides_sql(f"inf({oa:+d} f{a}, {ob:+d} f{b})", f"least({oa} * f{a}, {ob} * f{b})", "f") for a, oa, b, ob in _PAIR_CORNERS]])


@query("all_corners", _corner_sql(True))
def all_corners(spark, sf_dir):
    df = items(spark, sf_dir)
    return _sides(df, corners.all_corners(df, [features.Feature(n, F.col(n)) for n in NAMES[:3]]))


@query("with_corners", f"{_corner_sql(False)} UNION ALL SELECT 'inf(+1 f1, -1 again)', 0, 0, count(*) FROM f")
def with_corners(spark, sf_dir):
    df = items(spark, sf_dir)
    base = [features.Feature(n, F.col(n)) for n in NAMES[:3]]
    # A repeated and a negated feature add nothing but one side's corner with the other: no row.
    return _sides(df, corners.with_corners(df, [*base, features.Feature("again", F.col("f1")), features.Feature("not", -F.col("f2"))]))


@query(
    "separation_ids",
    f"WITH {ITEMS}, g AS (SELECT f0, f1, f2, -f1 AS w0, f2 AS w1, f0 * f1 AS w2 FROM f), m AS ("
    + " UNION ALL ".join(f"SELECT {j} AS wanted, {i} AS known, bool_and(w{j} = f{i}) AS plus, bool_and(w{j} = -f{i}) AS minus FROM g" for j in range(3) for i in range(3))
    + ") SELECT wanted, coalesce(min(known) FILTER (WHERE plus OR minus), -1) AS known, coalesce(min(CASE WHEN plus THEN 1 ELSE -1 END) FILTER (WHERE plus OR minus), 1) AS side FROM m GROUP BY wanted",
)
def separation_ids(spark, sf_dir):
    df = items(spark, sf_dir).withColumns({"w0": -F.col("f1"), "w1": F.col("f2"), "w2": F.col("f0") * F.col("f1")})
    found = corners.lookup(df, NAMES[:3], ["w0", "w1", "w2"])
    return spark.createDataFrame([(k, *x) for k, x in enumerate(found)], "wanted int, known int, side int")


_REAL = ("l_quantity - 20", "l_quantity - 10", "20 - l_quantity", "l_discount * 10 - 30")


@query(
    "le_real",
    "WITH v AS (SELECT " + ", ".join(f"{x} AS r{i}" for i, x in enumerate(_REAL)) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {p} AS oi, {q} AS oj, bool_and({p} * r{i} <= {q} * r{j}) AS le FROM v" for i in range(4) for j in range(4) if i != j for p in (-1, 1) for q in (-1, 1)),
)
def le_real(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*[F.expr(x).alias(f"r{i}") for i, x in enumerate(_REAL)])
    return counts.comparable_values(df, [f"r{i}" for i in range(4)])


@query(
    "first_crossing",
    f"WITH {ITEMS}, x AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, count(DISTINCT f{i} * 2 + f{j}) AS corners FROM f" for i in range(6) for j in range(i + 1, 6)) + ") SELECT i, j FROM x WHERE corners = 4 ORDER BY i, j LIMIT 1",
)
def first_crossing(spark, sf_dir):
    return spark.createDataFrame([counts.first_crossing(items(spark, sf_dir), NAMES)], "i int, j int")


@query(
    "atom_indicators",
    f"WITH {ITEMS}, a AS (SELECT f0, f1, min(f2) AS low, min(f4) AS f4 FROM f GROUP BY f0, f1) "
    "SELECT f0, f1, CASE WHEN low > 0 THEN 1 ELSE -1 END AS f2, (SELECT count(*) FROM f g WHERE g.f0 = a.f0 AND g.f1 = a.f1) AS rows FROM a",
)
def atom_indicators(spark, sf_dir):
    """Features on the atoms of two others, and back on the rows."""
    df = items(spark, sf_dir)
    member = counts.membership(df, counts.atomic_sets(df, ["f0", "f1"]), ["f0", "f1"])
    back = counts.from_atomic(counts.to_atomic(df, member, ["f0", "f1", "f2"]), member)
    return back.groupBy(*[F.col(n).cast("int").alias(n) for n in ("f0", "f1", "f2")]).agg(F.count("*").alias("rows"))


# -- orders and entropies --------------------------------------------------------------------
_ENTROPY = "(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM f GROUP BY f@))"


@query("order_entropy", f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT {i} AS feature, round(-{_ENTROPY.replace('@', str(i))}, 6) AS value" for i in range(6)))
def order_entropy(spark, sf_dir):
    return orders.order_entropy(items(spark, sf_dir), NAMES).select("feature", F.round("value", 6).alias("value"))


@query(
    "compound_order",
    f"WITH {ITEMS}, {LONG} SELECT feature, CAST(-abs(sum(v)) AS DOUBLE) AS key0, CAST(least(count(*) FILTER (WHERE v > 0), count(*) FILTER (WHERE v < 0)) AS DOUBLE) AS key1 FROM u GROUP BY feature",
)
def compound_order(spark, sf_dir):
    df = items(spark, sf_dir)
    return orders.compound([orders.order_balance(df, NAMES), orders.order_min_side(df, NAMES)])


@query(
    "split_information",
    f"WITH {_ORDERS}, h AS (SELECT {_H.format('o_orderstatus')} AS a, {_H.format('o_orderpriority, o_year')} AS b, {_H.format('o_orderstatus, o_orderpriority, o_year')} AS j) "
    "SELECT round(a + b - j, 5) AS shared, round(least(a, b), 5) AS least FROM h",
)
def split_information(spark, sf_dir):
    df, parts = order_columns(spark, sf_dir), [(["o_orderstatus"], ["o_orderpriority", "o_year"])]
    return spark.createDataFrame([(round(entropy.split_information(df, parts)[0], 5), round(entropy.split_information(df, parts, joint=False)[0], 5))], "shared double, least double")


_CENTRED = "z AS (SELECT f0, f1, l_quantity - 25 AS a, l_discount * 100 - 5 AS b FROM (SELECT l_quantity, l_discount, " + _ITEMS + " FROM lineitem))"


@query(
    "order_spectral",
    f"WITH {_CENTRED} " + " UNION ALL ".join(f"SELECT {i} AS feature, round(power(sum(a * f{i}), 2) + power(sum(b * f{i}), 2) + 0.5 * power(sum(f{i}), 2), 0) AS rows FROM z" for i in range(2)),
)
def order_spectral(spark, sf_dir):
    """With all singular vectors it is the order of the rows' products."""
    sides = [features.side(F.expr(CONDITIONS[i])).alias(f"f{i}") for i in range(2)]
    df = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("a"), (F.col("l_discount") * 100 - 5).alias("b"), *sides)
    out = orders.SpectralOrder(df, ["a", "b"], 2.0, 0.5).values(df, ["f0", "f1"])
    return out.select("feature", F.round("value", 0).alias("rows"))


@query(
    "order_spectral_columns",
    f"WITH {_CENTRED}, g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM z) SELECT 0 AS feature, round(aa + 2 * ab + bb + 0.5 * 4, 0) AS value FROM g UNION ALL SELECT 1, round(aa - 2 * ab + bb, 0) FROM g",
)
def order_spectral_columns(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("a"), (F.col("l_discount") * 100 - 5).alias("b"))
    order = orders.SpectralOrder(df, ["a", "b"], 2.0, 0.5, mode="cols")
    sides = spark.createDataFrame([(0, 1, 1), (1, 1, -1)], "pid int, same int, apart int")
    return order.values(sides, ["same", "apart"]).select("feature", F.round("value", 0).alias("value"))


# -- accords and rows ------------------------------------------------------------------------
_LEVELLED = (
    f"{_MAXIMAL}, o AS (SELECT unnest([0.5::DOUBLE, 1, 2, 3.5, 5, 8]) AS v, unnest(range(6)) AS k), "
    "d AS (SELECT x.path, max(CASE WHEN x.path = y.path THEN 0 ELSE (SELECT min(i) - 1 FROM (SELECT unnest(range(1, 7)) AS i) WHERE x.path[i] <> y.path[i]) END) AS apart FROM mx x, mx y GROUP BY x.path)"
)


@query(
    "visibility",
    f"{_LEVELLED} SELECT {_PATH.replace('path', 'd.path')} AS path, CAST(CASE WHEN len(d.path) < 6 THEN len(d.path) ELSE -1 END AS INTEGER) AS coherence, CAST(apart AS INTEGER) AS complexity, "
    "(SELECT v FROM o WHERE k = CASE WHEN len(d.path) < 6 THEN len(d.path) ELSE 5 END) - (SELECT v FROM o WHERE k = apart) AS visible FROM d",
)
def visibility(spark, sf_dir):
    found, a = _searched(spark, sf_dir)
    m = found.matrix(a)
    ends, apart = analysis.coherence_levels(m), analysis.complexity_levels(m)
    seen = analysis.visibility(m, np.array([0.5, 1, 2, 3.5, 5, 8]))
    rows = [("".join("-+"[int(x > 0)] for x in row if x), int(e), int(c), float(v)) for row, e, c, v in zip(m, ends, apart, seen, strict=True)]
    return spark.createDataFrame(rows, "path string, coherence int, complexity int, visible double")


@query("accords_without_prefixes", f"{_MAXIMAL} SELECT {_PATH} AS path FROM mx")
def accords_without_prefixes(spark, sf_dir):
    """Splitting nodes are beginnings of what continues them, and go."""
    found, a = _searched(spark, sf_dir)
    left = analysis.without_prefixes(found.matrix(a, include_splitting="levels"))
    return spark.createDataFrame([("".join("-+"[int(x > 0)] for x in row if x),) for row in left], "path string")


_ACCORD = np.array([[1, 1, -1, 0], [1, -1, -1, 1], [-1, 0, 1, 0]], np.int8)
_NATION_SIDES = (
    "v AS (SELECT CASE WHEN c_nationkey IN (0, 1) THEN 0 WHEN c_nationkey >= 12 THEN 1 ELSE -1 END AS f0, CASE WHEN c_nationkey IN (2, 3) THEN 0 WHEN c_acctbal > 4000 THEN 1 ELSE -1 END AS f1, "
    "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS f2, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE -1 END AS f3 FROM customer)"
)


def _two_sided(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    side = features.side
    return c.select(
        F.when(F.col("c_nationkey").isin(0, 1), 0).otherwise(side(F.col("c_nationkey") >= 12)).alias("f0"),
        F.when(F.col("c_nationkey").isin(2, 3), 0).otherwise(side(F.col("c_acctbal") > 4000)).alias("f1"),
        side(F.col("c_custkey") % 3 == 0).alias("f2"), side(F.col("c_custkey") % 5 == 0).alias("f3"),
    )


@query(
    "hard_clusters",
    f"WITH {_NATION_SIDES} SELECT CAST(f0 > 0 AND f1 > 0 AS INTEGER)::DOUBLE AS accord_0, CAST(f0 > 0 AND f1 <= 0 AS INTEGER)::DOUBLE AS accord_1, CAST(f0 <= 0 AS INTEGER)::DOUBLE AS accord_2, count(*) AS n FROM v GROUP BY ALL",
)
def hard_clusters(spark, sf_dir):
    columns = analysis.hard_clusters(_ACCORD, NAMES[:4])
    return _two_sided(spark, sf_dir).groupBy(*columns).agg(F.count("*").alias("n"))


@query(
    "soft_clusters",
    # The first split goes along with f2, negated; the second has f1 alone.
    f"WITH {_NATION_SIDES}, p AS (SELECT ((f0 + 1) / 2.0 + (1 - f2) / 2.0) / 2 AS a, (f1 + 1) / 2.0 AS b FROM v) "
    "SELECT CAST(a * b AS DOUBLE) AS accord_0, CAST(a * (1 - b) AS DOUBLE) AS accord_1, CAST(1 - a AS DOUBLE) AS accord_2, count(*) AS n FROM p GROUP BY ALL",
)
def soft_clusters(spark, sf_dir):
    columns = analysis.soft_clusters(_ACCORD, NAMES[:4])
    return _two_sided(spark, sf_dir).groupBy(*columns).agg(F.count("*").alias("n"))


@query(
    "subtrees",
    "SELECT * FROM (VALUES (0, 'first', 0, '110', '001'), (1, 'within', 1, '01', '10')) t(step, what, split, same, other)",
)
def subtrees(spark, sf_dir):
    """Where accords first part: a matrix of the driver's, given here in full."""
    k, (same, other) = analysis.subtrees(_ACCORD)
    rows = [(0, "first", k, same, other)]
    k, (a, b) = analysis.subtrees(_ACCORD[same])
    rows.append((1, "within", k, a, b))
    bits = lambda x: "".join("01"[int(v)] for v in x)
    return spark.createDataFrame([(s, w, int(c), bits(x), bits(y)) for s, w, c, x, y in rows], "step int, what string, split int, same string, other string")


@query(
    "score_columns",
    f"WITH {ITEMS}, x AS (SELECT pid, f0 - f1 + f2 AS a0, f0 - f1 - f2 AS a1 FROM f), s AS (SELECT (a0 - min(a0) OVER ()) / sum(a0 - (SELECT min(a0) FROM x)) OVER () AS s0, (a1 - min(a1) OVER ()) / sum(a1 - (SELECT min(a1) FROM x)) OVER () AS s1 FROM x) "
    "SELECT 0 AS accord, round(min(s0), 9) AS low, round(max(s0), 9) AS top, round(sum(s0), 6) AS total FROM s UNION ALL SELECT 1, round(min(s1), 9), round(max(s1), 9), round(sum(s1), 6) FROM s",
)
def score_columns(spark, sf_dir):
    accords = spark.createDataFrame([(0, 0, 1), (0, 1, -1), (0, 2, 1), (1, 0, 1), (1, 1, -1), (1, 2, -1)], "accord int, feature int, side int")
    out = analysis.accord_scores(items(spark, sf_dir), NAMES, accords, False, True)
    return out.groupBy("accord").agg(F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("top"), F.round(F.sum("score"), 6).alias("total"))


@query(
    "star_analytics",
    f"WITH {ITEMS} SELECT (SELECT count(*) FROM f WHERE f0 = 1 AND f1 = -1) AS location, (SELECT round(sum(exp(l_discount * 10) * l_quantity) / sum(exp(l_discount * 10)), 5) FROM lineitem) AS mean, "
    "(SELECT round(sum(-(l_tax - m) / s), 3) + 0.0 FROM lineitem, (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s FROM lineitem) WHERE l_quantity > 25) AS reversed",
)
def star_analytics(spark, sf_dir):
    df, raw = items(spark, sf_dir), read(spark, sf_dir, "lineitem")
    size = analysis.location_size(df, [("f0", 1), ("f1", -1)])
    mean = analysis.softmax_mean(raw.withColumn("s", F.col("l_discount") * 10), "s", "l_quantity").select(F.round("mean", 5).alias("mean"))
    keyed = analysis.keyed_standardize(raw.select("l_quantity", "l_tax", F.col("l_quantity").alias("q")), ["l_tax", "q"], ["l_tax"])
    total = keyed.where("l_quantity > 25").agg((F.round(F.sum("l_tax"), 3) + 0.0).alias("reversed"))
    return mean.crossJoin(F.broadcast(total)).select(F.lit(size).cast("long").alias("location"), "mean", "reversed")  # one row each


def _holds(term: logic.Term, names) -> Column:
    """A normal form as a condition on a table."""
    out = None
    for clause in term.clauses:
        part = None
        for v, s in clause:
            one = F.col(names[v]) * s > 0
            part = one if part is None else part & one if term.disjunctive else part | one
        out = part if out is None else out | part if term.disjunctive else out & part
    return out


@query(
    "normal_forms",
    f"WITH {ITEMS}, t AS (SELECT (f0 > 0 AND f1 < 0) OR (f2 > 0 AND f3 > 0) AS a, NOT ((f0 > 0 AND f1 < 0) OR (f2 > 0 AND f3 > 0)) AS b, ((f0 > 0 AND f1 < 0) OR (f2 > 0 AND f3 > 0)) AND (f1 > 0 OR f4 > 0) AS c, "
    "least(least(f0, -f1), f2) > 0 AS d, least(least(f0, -f1), f2) < 0 AS e FROM f) SELECT unnest(['dnf', 'cnf', 'not', 'and', 'corner', 'not corner']) AS term, "
    "unnest([count(*) FILTER (WHERE a), count(*) FILTER (WHERE a), count(*) FILTER (WHERE b), count(*) FILTER (WHERE c), count(*) FILTER (WHERE d), count(*) FILTER (WHERE e)]) AS n FROM t",
)
def normal_forms(spark, sf_dir):
    term = logic.Term.of(np.array([[1, 0], [-1, 0], [0, 1], [0, 1]]))
    other = logic.Term.of(np.array([[0, 0], [1, 0], [0, 0], [0, 0], [0, 1]]))
    parents = {6: ((0, 1), (1, -1)), 7: ((6, 1), (2, 1))}
    terms = {"dnf": term, "cnf": term.other(), "not": ~term, "and": term & other, "corner": logic.corner_term(7, 1, parents), "not corner": logic.corner_term(7, -1, parents)}
    one = items(spark, sf_dir).agg(*[F.count_if(_holds(t, NAMES)).alias(f"n{k}") for k, t in enumerate(terms.values())])
    each = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"n{k}").alias("n")) for k, n in enumerate(terms)])
    return one.select(F.explode(each).alias("s")).select("s.*")


# -- surveys searched ------------------------------------------------------------------------
def _accord_rows(spark, found):
    return spark.createDataFrame([(_text(tuple(int(x) for x in row if x)),) for row in found.matrix()], "path string")


@query("survey_accords", f"{_MAXIMAL} SELECT {_PATH} AS path FROM mx")
def survey_accords(spark, sf_dir):
    """Ready features, in the order given, searched above and asked again below."""
    s, own = item_survey(spark, sf_dir)
    a = int(s.df.count() * SHARE)
    found = surveys.SurveyAccords(s, 2 * a, features=own, order=None)
    found.search.tree.features[:] = range(6)
    found.change_agreement(a)
    return _accord_rows(spark, found)


@query("survey_accords_saved", f"{_MAXIMAL} SELECT {_PATH} AS path FROM mx")
def survey_accords_saved(spark, sf_dir):
    s, own = item_survey(spark, sf_dir)
    found = surveys.SurveyAccords(s, int(s.df.count() * SHARE), factory=lambda _: own, order=[0, 1, 2, 3, 4, 5])
    return _accord_rows(spark, surveys.SurveyAccords.load(s, found.save(_folder(spark, "accords"))))


@query(
    "survey_metadata",
    f"{_tree_sql()} SELECT CAST(level - 1 AS INTEGER) AS level, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus'][level] AS variable, "
    "CASE WHEN level <= 4 THEN '>=' ELSE '==' END AS operator, count(*) AS n FROM nodes WHERE level > 0 GROUP BY level",
)
def survey_metadata(spark, sf_dir):
    s, own = item_survey(spark, sf_dir)
    a = int(s.df.count() * SHARE)
    found = surveys.SurveyAccords(s, a, features=own, order=None)
    sizes = spark.createDataFrame([(k - 1, n) for k, n in enumerate(found.search.tree.level_sizes(a)) if k and n], "level int, n long")
    used = found.specified()
    told = found.metadata_table().where(F.col("feature").isin(used))
    return told.select("level", "variable", "operator").join(F.broadcast(sizes), "level")  # a row for each level


@query(
    "explained_corner",
    "SELECT * FROM (VALUES ('corner', 'l_quantity >= 26 and l_returnflag != R'), ('other side', 'l_quantity < 26'), ('other side', 'l_returnflag == R')) t(side, says)",
)
def explained_corner(spark, sf_dir):
    """What both sides of a corner say, in words that don't depend on the rows."""
    _, own = item_survey(spark, sf_dir)
    made = corners.corners(own[0], own[4])
    corner = made[corners.CORNERS.index((1, -1))]
    known = {f.name: f for f in own}
    rows = [(name, " and ".join(f"{c} {op} {v}" for c, op, v in part)) for name, s in (("corner", 1), ("other side", -1)) for part in surveys.explain(corner, s, known)]
    return spark.createDataFrame(rows, "side string, says string")
