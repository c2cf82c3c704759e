"""Queries over the star-schema tables, one for each operator, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entropy, scaling
from ..operators import analysis, corners, counts, features, graphs, orders, surveys
from ..sources import generators
from ..sources.surveys import Variable
from . import search as plans
from . import uncross

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NAMES = [f"f{i}" for i in range(6)]
#: Six features of line items, as conditions that Spark and DuckDB read alike.
CONDITIONS = ["l_quantity >= 26", "l_extendedprice >= 50000", "l_discount >= 0.05", "l_tax >= 0.04", "l_returnflag = 'R'", "l_linestatus = 'O'"]
#: A line item's number in its file is its id; several files stand in the order of their names.
_ITEMS = ", ".join(f"CASE WHEN {c} THEN 1 ELSE -1 END AS f{i}" for i, c in enumerate(CONDITIONS))
ITEMS = f"f AS (SELECT row_number() OVER () - 1 AS pid, l_shipdate, {_ITEMS} FROM lineitem)"
PAIRS = [(i, j) for i in range(6) for j in range(i + 1, 6)]
LONG = "u AS (" + " UNION ALL ".join(f"SELECT pid, {i} AS feature, f{i} AS v FROM f" for i in range(6)) + ")"
#: Least number of rows that three sides share, as a share of all; and its SQL.
SHARE = 0.115


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_ids(df: DataFrame) -> DataFrame:
    """``pid``: the number of a row in its file, the same at each reading. Several files, which
    then are few, stand in the order of their names."""
    files = sorted(df.inputFiles())
    number = F.col("_metadata.row_index")
    if len(files) > 1:
        place = F.create_map(*[F.lit(x) for k, f in enumerate(files) for x in (f.rsplit("/", 1)[-1], k)])
        number = number + place[F.col("_metadata.file_name")].cast("long") * F.lit(1 << 40)
    return df.withColumn("pid", number)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [features.side(F.expr(c)).alias(n) for c, n in zip(CONDITIONS, NAMES, strict=True)]
    return row_ids(read(spark, sf_dir, "lineitem")).select("pid", "l_shipdate", *sides)


def _positive(df: DataFrame, found: list[features.Feature], by_name: bool = True) -> DataFrame:
    named = [f.named(f"x{i}") for i, f in enumerate(found)]
    each = [
        F.struct(F.lit(f.name if by_name else str(i)).alias("feature"), F.count_if(n.column > 0).alias("positive"))
        for i, (f, n) in enumerate(zip(found, named, strict=True))
    ]
    return surveys._rows(df, each)


# -- features --------------------------------------------------------------------------------
@query("feat_onehot", "SELECT 'p_brand == ' || p_brand AS feature, count(*) AS positive FROM part GROUP BY p_brand")
def feat_onehot(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "part")
    return _positive(df, features.one_hot(df, "p_brand"))


@query(
    "feat_ge_splits",
    "WITH v AS (SELECT DISTINCT p_size AS v FROM part) SELECT 'p_size >= ' || v.v AS feature, count(*) AS positive FROM v, part "
    "WHERE p_size >= v.v AND v.v > (SELECT min(p_size) FROM part) GROUP BY v.v",
)
def feat_ge_splits(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "part")
    return _positive(df, features.ge_splits(df, "p_size"))


@query(
    "feat_regular_ge",
    "WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), s AS (SELECT unnest(range(1, 5)) AS s) "
    "SELECT CAST(s - 1 AS VARCHAR) AS feature, count(*) FILTER (WHERE o_totalprice >= lo * (1 - s / 5.0::DOUBLE) + hi * (s / 5.0::DOUBLE)) AS positive "
    "FROM orders, l, s GROUP BY s",
)
def feat_regular_ge(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "orders")
    return _positive(df, features.regular_ge(df, "o_totalprice"), by_name=False)


@query(
    "feat_bins",
    "WITH l AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), s AS (SELECT unnest(range(0, 5)) AS s), "
    "b AS (SELECT s, lo * (1 - s / 5.0::DOUBLE) + hi * (s / 5.0::DOUBLE) AS a, lo * (1 - (s + 1) / 5.0::DOUBLE) + hi * ((s + 1) / 5.0::DOUBLE) AS z FROM l, s) "
    "SELECT CAST(s AS VARCHAR) AS feature, count(*) FILTER (WHERE c_acctbal >= a AND (c_acctbal < z OR s = 4 AND c_acctbal <= z)) AS positive FROM customer, b GROUP BY s",
)
def feat_bins(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "customer")
    return _positive(df, features.regular_bins(df, "c_acctbal"), by_name=False)


@query("feat_median", "SELECT '0' AS feature, count(*) AS positive FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)")
def feat_median(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "orders")
    return _positive(df, features.median_split(df, "o_totalprice"), by_name=False)


@query(
    "feat_axis_cuts",
    "WITH l AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_discount) AS lo2, max(l_discount) AS hi2 FROM lineitem), "
    "s AS (SELECT unnest(range(1, 4)) AS j) SELECT CAST(j - 1 AS VARCHAR) AS feature, count(*) FILTER (WHERE l_quantity < lo + (hi - lo) * j / 4) AS positive FROM lineitem, l, s GROUP BY j "
    "UNION ALL SELECT CAST(j + 2 AS VARCHAR), count(*) FILTER (WHERE l_discount < lo2 + (hi2 - lo2) * j / 4) FROM lineitem, l, s GROUP BY j",
)
def feat_axis_cuts(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "lineitem")
    return _positive(df, features.axis_thresholds(df, ["l_quantity", "l_discount"], 3), by_name=False)


@query(
    "invalid_both_sides",
    "WITH v AS (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_nationkey NOT IN (0, 1)) SELECT 'c_nationkey >= ' || v.v AS feature, "
    "count(*) FILTER (WHERE c_nationkey >= v.v) AS positive, count(*) FILTER (WHERE c_nationkey >= v.v OR c_nationkey IN (0, 1)) AS ge_zero, "
    "count(*) FILTER (WHERE c_nationkey < v.v) AS le_zero FROM v, customer WHERE v.v > (SELECT min(v) FROM v) GROUP BY v.v",
)
def invalid_both_sides(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "customer")
    found = features.invalid_to_both_sides(features.ge_splits(df, "c_nationkey", [0, 1]), "c_nationkey", [0, 1])
    return counts.side_counts(df.select(*[f.column.alias(f.name) for f in found]), [f.name for f in found])


# -- counts ----------------------------------------------------------------------------------
@query(
    "side_counts",
    f"WITH {ITEMS}, {LONG} SELECT 'f' || feature AS feature, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v >= 0) AS ge_zero, "
    "count(*) FILTER (WHERE v <= 0) AS le_zero FROM u GROUP BY u.feature",
)
def side_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.side_counts(items(spark, sf_dir), NAMES)


@query("atoms", f"WITH {ITEMS} SELECT f0, f1, f2, f3, f4, f5, count(*) AS w FROM f GROUP BY ALL")
def atoms(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.atoms(items(spark, sf_dir), NAMES).select(*[F.col(n).cast("int").alias(n) for n in NAMES], "w")


@query(
    "atomic_sets",
    f"WITH {ITEMS} SELECT f0, f1, f2, f3, f4, f5, count(*) AS w, min(pid) AS first_pid, row_number() OVER (ORDER BY f0, f1, f2, f3, f4, f5) - 1 AS aid FROM f GROUP BY f0, f1, f2, f3, f4, f5",
)
def atomic_sets(spark, sf_dir):  # noqa: ANN001, ANN201
    out = counts.atomic_sets(items(spark, sf_dir), NAMES)
    return out.select(*[F.col(n).cast("int").alias(n) for n in NAMES], "w", "first_pid", F.col("aid").cast("long").alias("aid"))


@query(
    "unique_rows",
    f"WITH {ITEMS} SELECT f1, f4, count(*) AS n, min(pid) AS first_pid, row_number() OVER (ORDER BY min(pid)) - 1 AS aid FROM f GROUP BY f1, f4",
)
def unique_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    out = counts.unique_rows(items(spark, sf_dir), ["f1", "f4"])
    return out.select(F.col("f1").cast("int").alias("f1"), F.col("f4").cast("int").alias("f4"), "n", "first_pid", F.col("aid").cast("long").alias("aid"))


@query("infimum", f"WITH {ITEMS} SELECT least(f0, -f2, f5) AS v, count(*) AS n FROM f GROUP BY 1")
def infimum(spark, sf_dir):  # noqa: ANN001, ANN201
    v = counts.infimum([("f0", 1), ("f2", -1), ("f5", 1)]).cast("int")
    return items(spark, sf_dir).groupBy(v.alias("v")).agg(F.count("*").alias("n"))


@query("agreement_pair")
def agreement_pair(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.tuple_counts(items(spark, sf_dir), NAMES, 2)


_SIDES = "s AS (SELECT w, [" + ", ".join(f"{2 * i} + (f{i} + 1) // 2" for i in range(6)) + "] AS l FROM (SELECT f0, f1, f2, f3, f4, f5, count(*) AS w FROM f GROUP BY ALL))"
_TRIPLES = (
    f"{_SIDES}, t AS (SELECT a.s AS s1, b.s AS s2, c.s AS s3, CAST(sum(w) AS BIGINT) AS n FROM s, LATERAL (SELECT unnest(l) AS s) a, "
    "LATERAL (SELECT unnest(l) AS s) b, LATERAL (SELECT unnest(l) AS s) c WHERE a.s <= b.s AND b.s <= c.s GROUP BY 1, 2, 3)"
)
SQL["agreement_pair"] = (
    f"WITH {ITEMS}, {_SIDES} SELECT CAST(a.s AS INTEGER) AS s1, CAST(b.s AS INTEGER) AS s2, CAST(sum(w) AS BIGINT) AS n FROM s, LATERAL (SELECT unnest(l) AS s) a, "
    "LATERAL (SELECT unnest(l) AS s) b WHERE a.s <= b.s GROUP BY 1, 2"
)


@query("agreement_triple", f"WITH {ITEMS}, {_TRIPLES} SELECT s1, s2, s3, n FROM t")
def agreement_triple(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.tuple_counts(items(spark, sf_dir), NAMES, 3)


@query(
    "agreement_both_sides",
    "WITH c AS (SELECT CASE WHEN c_nationkey IN (0, 1) THEN 0 WHEN c_nationkey >= 12 THEN 1 ELSE -1 END AS a, CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END AS b FROM customer) "
    "SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS n FROM c",
)
def agreement_both_sides(spark, sf_dir):  # noqa: ANN001, ANN201
    base = features.Feature("a", features.side(F.col("c_nationkey") >= 12))
    found = [*features.invalid_to_both_sides([base], "c_nationkey", [0, 1]), features.Feature("b", features.threshold(F.col("c_acctbal")))]
    df = read(spark, sf_dir, "customer").select(*[f.column.alias(f.name) for f in found])
    return df.agg(counts.agreement(df, [("a", 1), ("b", 1)]).alias("n"))


@query(
    "agreement_real",
    "WITH c AS (SELECT l_quantity - 20 AS a, l_discount - 0.03 AS b FROM lineitem) SELECT round(coalesce(sum(a - b) FILTER (WHERE a > 0 AND b < 0), 0), 4) AS total FROM c",
)
def agreement_real(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 20).alias("a"), (F.col("l_discount") - 0.03).alias("b"))
    return df.agg(F.round(counts.real_agreement([("a", 1), ("b", -1)]), 4).alias("total"))


_PAIR = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, f{i} AS a, f{j} AS b, count(*) AS n FROM f GROUP BY ALL" for i, j in PAIRS)


@query("pair_contingency", f"WITH {ITEMS} {_PAIR}")
def pair_contingency(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.pair_contingency(items(spark, sf_dir), NAMES)


_LE = (
    f"p AS ({_PAIR}), q AS (SELECT * FROM p UNION ALL SELECT j, i, b, a, n FROM p), o AS (SELECT unnest([-1, 1]) AS o), "
    "le AS (SELECT i, j, x.o AS oi, y.o AS oj, coalesce(sum(n) FILTER (WHERE a * x.o >= 0 AND b * y.o < 0 OR b * y.o <= 0 AND a * x.o > 0), 0) = 0 AS le FROM q, o x, o y GROUP BY ALL)"
)


@query("le_matrix", f"WITH {ITEMS}, {_LE} SELECT i, j, oi, oj, le FROM le")
def le_matrix(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.comparable(items(spark, sf_dir), NAMES)


@query("crossing_pairs", f"WITH {ITEMS}, {_LE} SELECT i, j FROM le WHERE i < j GROUP BY i, j HAVING NOT bool_or(le)")
def crossing_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    return counts.crossing_pairs(items(spark, sf_dir), NAMES)


_REPEATS = "g AS (SELECT f0 AS c0, f1 AS c1, f2 AS c2, -f0 AS c3, f2 AS c4 FROM f)"


@query(
    "unique_columns",
    f"WITH {ITEMS}, {_REPEATS}, m AS ("
    + " UNION ALL ".join(f"SELECT {j} AS k, {i} AS first, bool_and(c{j} = c{i}) AS plus, bool_and(c{j} = -c{i}) AS minus FROM g" for j in range(5) for i in range(j + 1))
    + "), s AS (SELECT k, min(first) AS first FROM m WHERE plus OR minus GROUP BY k) SELECT CAST(s.k AS BIGINT) AS column, s.first, CASE WHEN plus THEN 1 ELSE -1 END AS side FROM s JOIN m USING (k, first)",
)
def unique_columns(spark, sf_dir):  # noqa: ANN001, ANN201
    df = items(spark, sf_dir).withColumn("f6", (-F.col("f0")).cast("tinyint")).withColumn("f7", F.col("f2"))
    found = corners.identify(df, ["f0", "f1", "f2", "f6", "f7"])
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(found.first, found.side, strict=True))], "column long, first int, side int")


# -- search ----------------------------------------------------------------------------------
def _tree_sql() -> str:
    """One step for each level: the least count of the new side with any two of the path."""
    parts = [f"WITH {ITEMS}, {_TRIPLES}, m AS (SELECT count(*) AS n, CAST(floor(count(*) * {SHARE}) AS BIGINT) AS a FROM f), p0 AS (SELECT CAST([] AS INTEGER[]) AS path, n AS agreement FROM m)"]
    for k in range(6):
        parts.append(
            f"p{k + 1} AS (SELECT list_append(c.path, CAST(c.s AS INTEGER)) AS path, least(c.agreement, min(coalesce(t.n, 0))) AS agreement FROM "
            f"(SELECT p.path, p.agreement, s.s FROM p{k} p, m, (SELECT unnest([{2 * k}, {2 * k + 1}]) AS s) s WHERE p.agreement >= m.a) c, "
            "LATERAL (SELECT unnest(list_append(c.path, CAST(c.s AS INTEGER))) AS x) x, LATERAL (SELECT unnest(list_append(c.path, CAST(c.s AS INTEGER))) AS y) y "
            "LEFT JOIN t ON t.s1 = x.x AND t.s2 = y.y AND t.s3 = c.s WHERE x.x <= y.y GROUP BY c.path, c.s, c.agreement)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS level, path, agreement FROM p{k}" for k in range(7))
    return ", ".join(parts) + f", nodes AS (SELECT e.* FROM ({every}) e, m WHERE e.agreement >= m.a)"


_PATH = "array_to_string(list_transform(path, lambda s: CASE WHEN s % 2 = 1 THEN '+' ELSE '-' END), '')"


def _bound(df: DataFrame) -> int:
    return int(df.count() * SHARE)


def _searched(spark: SparkSession, sf_dir: str) -> tuple[plans.Search, int]:
    df = items(spark, sf_dir)
    a = _bound(df)
    return plans.search(df, NAMES, a), a


def _text(path: tuple[int, ...]) -> str:
    return "".join("+" if s > 0 else "-" for s in path)


@query("accord_search", f"{_tree_sql()} SELECT level, {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement FROM nodes")
def accord_search(spark, sf_dir):  # noqa: ANN001, ANN201
    found, a = _searched(spark, sf_dir)
    rows = [(n.level, _text(n.path), int(n.agreement)) for n in found.tree.root.walk() if n.agreement >= a]
    return spark.createDataFrame(rows, "level int, path string, agreement long")


@query(
    "maximal_accords",
    f"{_tree_sql()} SELECT n.level, {_PATH.replace('path', 'n.path')} AS path, CAST(n.agreement AS BIGINT) AS agreement FROM nodes n "
    "WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.level = n.level + 1 AND c.path[1:n.level] = n.path)",
)
def maximal_accords(spark, sf_dir):  # noqa: ANN001, ANN201
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(n.level, _text(n.path), int(n.agreement)) for n in found.tree.maximal(a)], "level int, path string, agreement long")


@query("k_accords", f"{_tree_sql()} SELECT {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement FROM nodes WHERE level = 3")
def k_accords(spark, sf_dir):  # noqa: ANN001, ANN201
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(_text(n.path), int(n.agreement)) for n in found.tree.at_level(3, a)], "path string, agreement long")


@query(
    "efficient_distinguishers",
    f"{_tree_sql()} SELECT DISTINCT level - 1 AS feature FROM (SELECT level, path[1:level - 1] AS parent FROM nodes WHERE level > 0 GROUP BY 1, 2 HAVING count(*) = 2)",
)
def efficient_distinguishers(spark, sf_dir):  # noqa: ANN001, ANN201
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(k,) for k in found.tree.distinguishers(a)], "feature int")


@query("level_sizes", f"{_tree_sql()} SELECT level, count(*) AS n FROM nodes GROUP BY level")
def level_sizes(spark, sf_dir):  # noqa: ANN001, ANN201
    found, a = _searched(spark, sf_dir)
    return spark.createDataFrame([(k, n) for k, n in enumerate(found.tree.level_sizes(a)) if n], "level int, n long")


@query(
    "lowered_agreement",
    f"{_tree_sql()} SELECT level, {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement FROM nodes",
)
def lowered_agreement(spark, sf_dir):  # noqa: ANN001, ANN201
    df = items(spark, sf_dir)
    a = _bound(df)
    found = plans.search(df, NAMES, 1, max_features=0)
    found.tree.features.extend(range(len(NAMES)))
    found.lower_agreement(2 * a)
    found.lower_agreement(a)
    rows = [(n.level, _text(n.path), int(n.agreement)) for n in found.tree.root.walk() if n.agreement >= a]
    return spark.createDataFrame(rows, "level int, path string, agreement long")


_EARLY = "l_shipdate < TIMESTAMP '1997-01-01'"
_MAJORITY = "maj AS (SELECT " + ", ".join(f"CAST(sign(sum(f{i})) AS INTEGER) AS m{i}" for i in range(6)) + f" FROM f WHERE {_EARLY})"


@query(
    "guided_path",
    f"{_tree_sql()}, {_MAJORITY}, w AS (SELECT [" + ", ".join(f"{2 * i} + (m{i} + 1) // 2" for i in range(6)) + "] AS l, list_position([" + ", ".join(f"m{i}" for i in range(6)) + "], 0) AS tie FROM maj) "
    f"SELECT level, {_PATH} AS path, CAST(agreement AS BIGINT) AS agreement, true AS guiding FROM nodes, w WHERE path = l[1:level] AND level < coalesce(nullif(tie, 0), 7) ORDER BY level DESC LIMIT 1",
)
def guided_path(spark, sf_dir):  # noqa: ANN001, ANN201
    df = items(spark, sf_dir)
    a = _bound(df)
    found = plans.search(df, NAMES, a)
    early = "l_shipdate < TIMESTAMP_NTZ'1997-01-01'"
    node = plans.guided(found.tree, df, NAMES, early, a)
    return spark.createDataFrame([(node.level, _text(node.path), int(node.agreement), plans.is_guiding(node, df, NAMES, early))], "level int, path string, agreement long, guiding boolean")


# -- orders ----------------------------------------------------------------------------------
_SIDED = (
    "g AS (SELECT unnest(range(6)) AS k), w AS (SELECT [f0, f1, f2, f3, f4, f5] AS v, count(*) AS n FROM f GROUP BY ALL), "
    "c AS (SELECT x.k AS f, y.k AS g, sum(n) FILTER (WHERE v[x.k + 1] >= 0 AND v[y.k + 1] >= 0) AS ap, sum(n) FILTER (WHERE v[x.k + 1] <= 0 AND v[y.k + 1] >= 0) AS bp, "
    "sum(n) FILTER (WHERE v[x.k + 1] >= 0 AND v[y.k + 1] <= 0) AS an, sum(n) FILTER (WHERE v[x.k + 1] <= 0 AND v[y.k + 1] <= 0) AS bn FROM w, g x, g y GROUP BY ALL), "
    "d AS (SELECT f, CAST(coalesce(ap, 0) AS BIGINT) AS ap, CAST(coalesce(bp, 0) AS BIGINT) AS bp, CAST(coalesce(an, 0) AS BIGINT) AS an, CAST(coalesce(bn, 0) AS BIGINT) AS bn FROM c)"
)


def _order(name: str, value: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(items(spark, sf_dir), NAMES)
    SQL[name] = f"WITH {ITEMS}, {_SIDED} SELECT CAST(f AS INTEGER) AS feature, CAST(sum({value}) AS BIGINT) AS value FROM d GROUP BY f"


_order("order_o1", "ap * bp + an * bn", orders.order_o1)
_order("order_o1_biased", "ap * bp", orders.order_o1_biased)
_order("order_o2", "least(ap, bp) + least(an, bn)", orders.order_o2)
_order("order_o3", "least(ap, bp)", orders.order_o3)


@query("order_balance", f"WITH {ITEMS}, {LONG} SELECT feature, CAST(-abs(sum(v)) AS DOUBLE) AS value FROM u GROUP BY feature")
def order_balance(spark, sf_dir):  # noqa: ANN001, ANN201
    return orders.order_balance(items(spark, sf_dir), NAMES)


@query(
    "order_min_side",
    f"WITH {ITEMS}, {LONG} SELECT feature, CAST(least(count(*) FILTER (WHERE v > 0), count(*) FILTER (WHERE v < 0)) AS DOUBLE) AS value FROM u GROUP BY feature",
)
def order_min_side(spark, sf_dir):  # noqa: ANN001, ANN201
    return orders.order_min_side(items(spark, sf_dir), NAMES)


#: Features of a row's number that are as balanced as each other, so that rows decide; and two more.
_TIED = ["pid % 4 < 2", "pid % 2 = 0", "pid % 4 IN (0, 3)", "pid % 8 < 4", "l_quantity >= 26", "NOT (l_quantity >= 26)"]
_SIDED_BY_ROWS = ", ".join(f"CASE WHEN {c} THEN 1 ELSE -1 END AS f{i}" for i, c in enumerate(_TIED))


@query(
    "injective_rank",
    f"WITH t AS (SELECT pid, {_SIDED_BY_ROWS} FROM (SELECT row_number() OVER () - 1 AS pid, l_quantity FROM lineitem)), "
    "u AS (" + " UNION ALL ".join(f"SELECT pid, {i} AS feature, f{i} AS v FROM t" for i in range(6)) + "), "
    "k AS (SELECT feature, abs(sum(v)) AS lean, list(v ORDER BY pid DESC) AS l, arg_min(v, pid) AS first FROM u GROUP BY feature) "
    "SELECT feature, CAST(lean // 8 AS DOUBLE) AS value, CAST(row_number() OVER (ORDER BY lean // 8, lean DESC, list_transform(l, lambda x: -x * first), feature) - 1 AS INTEGER) AS rank FROM k",
)
def injective_rank(spark, sf_dir):  # noqa: ANN001, ANN201
    df = row_ids(read(spark, sf_dir, "lineitem"))
    df = df.select("pid", *[features.side(F.expr(c)).alias(n) for c, n in zip(_TIED, NAMES, strict=True)])
    coarse = orders.order_balance(df, NAMES).select("feature", F.floor(-F.col("value") / 8).cast("double").alias("value"))
    return orders.injective_rank(df, NAMES, coarse)


POINT_FEATURES = ["n0", "n1", "n2"]
#: Customers of one nation whose numbers differ by so much at most are joined.
REACH = 120
_CUSTOMERS = (
    "p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS n0, CASE WHEN c_acctbal >= 4000 THEN 1 ELSE -1 END AS n1, CASE WHEN c_mktsegment < 'FURN' THEN 1 ELSE -1 END AS n2 FROM customer), "
    "e AS (SELECT a.c_custkey AS src, b.c_custkey AS dst, CAST(1 + (a.c_custkey + b.c_custkey) % 3 AS DOUBLE) AS w FROM customer a JOIN customer b "
    f"ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey AND abs(a.c_custkey - b.c_custkey) <= {REACH}), "
    "j AS (SELECT w, s.pid AS src, d.pid AS dst, s.n0 AS s0, d.n0 AS d0, s.n1 AS s1, d.n1 AS d1, s.n2 AS s2, d.n2 AS d2 FROM e JOIN p s ON s.pid = e.src JOIN p d ON d.pid = e.dst), "
    "h AS (SELECT p.pid, n0, n1, n2, coalesce(sum(w), 0) AS deg FROM p LEFT JOIN e ON e.src = p.pid GROUP BY ALL)"
)


def customer_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, side = read(spark, sf_dir, "customer"), features.side
    points = c.select(
        F.col("c_custkey").alias("pid"), side(F.col("c_custkey") % 2 == 0).alias("n0"), side(F.col("c_acctbal") >= 4000).alias("n1"), side(F.col("c_mktsegment") < "FURN").alias("n2")
    )
    # Numbers within reach are listed, so the join is one by equal keys. Rows are few and small
    # before that, so all cores get their share first.
    near = c.select("c_custkey", "c_nationkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("n"), F.explode(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + REACH)).alias("dst"))
    ends = near.join(c.select(F.col("c_custkey").alias("dst"), F.col("c_nationkey").alias("n")), ["dst", "n"])
    half = ends.select("src", "dst", (1 + (F.col("src") + F.col("dst")) % 3).cast("double").alias("w"))
    return graphs.both_ways(half), points


def _graph_order(name: str, value: str, f: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, points = customer_graph(spark, sf_dir)
        return f(edges, points, POINT_FEATURES).select("feature", F.round("value", 6).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_CUSTOMERS} " + " UNION ALL ".join(f"SELECT {i} AS feature, round({value.replace('@', str(i))}, 6) AS value" for i in range(3))


_graph_order("cut_weight", "(SELECT coalesce(sum(w) FILTER (WHERE s@ <> d@), 0) / 2 FROM j)", orders.cut_weight)
_graph_order(
    "ratio_cut",
    "(SELECT (sum(w) - sum(w * s@ * d@)) / 4 FROM j) * (SELECT CAST(count(*) AS DOUBLE) / greatest(count(*) FILTER (WHERE n@ > 0) * count(*) FILTER (WHERE n@ < 0), 1) FROM p)",
    orders.ratio_cut,
)
_graph_order(
    "normalised_cut",
    "(SELECT coalesce(sum(w) FILTER (WHERE s@ <> d@), 0) / 2 FROM j) * (SELECT sum(deg) / (sum(deg) FILTER (WHERE n@ > 0) * sum(deg) FILTER (WHERE n@ < 0)) FROM h)",
    orders.normalised_cut,
)
_graph_order("similarity_order", "(SELECT -0.5 * sum(w * s@ * d@) FROM j)", orders.similarity_order)
_graph_order(
    "matrix_order", "(SELECT sum(w * s@ * d@) FROM j) + 0.5 * (SELECT power(sum(n@), 2) FROM p)", lambda e, p, n: orders.matrix_order(e, p, n, 0.5)
)
_graph_order(
    "covariance_order",
    "(SELECT sum(x * x) FROM (SELECT sum(w * d@) AS x FROM j GROUP BY src)) + 0.5 * (SELECT power(sum(n@), 2) FROM p)",
    lambda e, p, n: orders.covariance_order(e.select(F.col("src").alias("row"), F.col("dst").alias("src"), "w"), p, n, 0.5),
)


@query("discrete_derivative", f"WITH {_CUSTOMERS} SELECT p.pid, CAST(coalesce(sum(w * s1 * d1), 0) AS DOUBLE) AS change FROM p LEFT JOIN j ON j.src = p.pid GROUP BY p.pid")
def discrete_derivative(spark, sf_dir):  # noqa: ANN001, ANN201
    edges, points = customer_graph(spark, sf_dir)
    return orders.discrete_derivative(edges, points, "n1")


# -- entropies -------------------------------------------------------------------------------
COLUMNS = ["o_orderstatus", "o_orderpriority", "o_year"]
_ORDERS = "o AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS o_year FROM orders)"
_H = "(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM o GROUP BY {}))"


def order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("o_year"))


@query("entropy", f"WITH {_ORDERS} " + " UNION ALL ".join(f"SELECT '{c}' AS col, round({_H.format(c)}, 6) AS value" for c in COLUMNS))
def entropy_(spark, sf_dir):  # noqa: ANN001, ANN201
    return entropy.entropies(order_columns(spark, sf_dir), COLUMNS).select("col", F.round("value", 6).alias("value"))


@query("joint_entropy", f"WITH {_ORDERS} SELECT round({_H.format(', '.join(COLUMNS))}, 6) AS value")
def joint_entropy(spark, sf_dir):  # noqa: ANN001, ANN201
    return entropy.joint_entropy(order_columns(spark, sf_dir), COLUMNS).select(F.round("value", 6).alias("value"))


_MI = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


@query("pairwise_mi", f"WITH {_ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_H.format(a)} + {_H.format(b)} - {_H.format(a + ', ' + b)}, 5) + 0.0 AS value" for a, b in _MI))
def pairwise_mi(spark, sf_dir):  # noqa: ANN001, ANN201
    out = entropy.pairwise_mutual_information(order_columns(spark, sf_dir), COLUMNS)
    return out.select("a", "b", (F.round("value", 5) + 0.0).alias("value"))


@query(
    "info_gain",
    f"WITH {_ORDERS} SELECT 'o_year' AS feature, round({_H.format('o_year')} + {_H.format('o_orderstatus, o_orderpriority')} - {_H.format('o_orderstatus, o_orderpriority, o_year')}, 5) AS value",
)
def info_gain(spark, sf_dir):  # noqa: ANN001, ANN201
    out = entropy.information_gain(order_columns(spark, sf_dir), COLUMNS[:2], ["o_year"])
    return out.select("feature", F.round("value", 5).alias("value"))


@query(
    "pointwise_gain",
    f"WITH {_ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, 'o_year' AS b, round({_H.format(a)} + {_H.format('o_year')} - {_H.format(a + ', o_year')}, 5) + 0.0 AS value" for a in COLUMNS[:2]),
)
def pointwise_gain(spark, sf_dir):  # noqa: ANN001, ANN201
    out = entropy.pointwise_gains(order_columns(spark, sf_dir), COLUMNS[:2], ["o_year"])
    return out.select("a", "b", (F.round("value", 5) + 0.0).alias("value"))


# -- analysis --------------------------------------------------------------------------------
_SCORE = "x AS (SELECT pid, f0 - f1 + f2 AS a0, f0 - f1 - f2 AS a1, -f0 - f1 + f3 AS a2 FROM f), y AS (" + " UNION ALL ".join(f"SELECT pid, {k} AS accord, a{k} AS s FROM x" for k in range(3)) + ")"
_ACCORDS = [(0, 0, 1), (0, 1, -1), (0, 2, 1), (1, 0, 1), (1, 1, -1), (1, 2, -1), (2, 0, -1), (2, 1, -1), (2, 3, 1)]


def _scores(spark: SparkSession, sf_dir: str, rows: bool) -> DataFrame:
    accords = spark.createDataFrame(_ACCORDS, "accord int, feature int, side int")
    out = analysis.accord_scores(items(spark, sf_dir), NAMES, accords, rows, False)
    return out.groupBy("accord").agg(F.count("*").alias("n"), (F.round(F.sum("score"), 3) + 0.0).alias("total"), F.round(F.max("score"), 6).alias("top"))


@query("accord_score", f"WITH {ITEMS}, {_SCORE} SELECT accord, count(*) AS n, round(sum(s)::DOUBLE, 3) + 0.0 AS total, round(max(s)::DOUBLE, 6) AS top FROM y GROUP BY accord")
def accord_score(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scores(spark, sf_dir, False)


@query(
    "score_rows",
    f"WITH {ITEMS}, x AS (SELECT f0 - f1 + f2 AS a0, f0 - f1 - f2 AS a1, -f0 - f1 + f3 AS a2, least(f0 - f1 + f2, f0 - f1 - f2, -f0 - f1 + f3) AS m FROM f), "
    "y AS (" + " UNION ALL ".join(f"SELECT {k} AS accord, CASE WHEN a0 + a1 + a2 - 3 * m > 0 THEN (a{k} - m)::DOUBLE / (a0 + a1 + a2 - 3 * m) ELSE 0.0::DOUBLE END AS s FROM x" for k in range(3)) + ") "
    "SELECT accord, count(*) AS n, round(sum(s), 3) + 0.0 AS total, round(max(s), 6) AS top FROM y GROUP BY accord",
)
def score_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scores(spark, sf_dir, True)


# -- graphs ----------------------------------------------------------------------------------
_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x))) / sqrt(list_sum(list_transform(b.v, lambda x: x * x)))"
_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@query("cosine_sim", f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT src, dst, round(w, 5) AS w FROM s WHERE w >= 0.3")
def cosine_sim(spark, sf_dir):  # noqa: ANN001, ANN201
    out = graphs.cosine_similarity(vectors(spark, sf_dir), "v", 0.3, id_col="vec_id")
    return out.select("src", "dst", F.round("w", 5).alias("w"))


@query(
    "cosine_neighbours",
    f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM s), t AS (SELECT src, dst, w / 2 AS w FROM r WHERE r <= 3) "
    "SELECT src, dst, round(sum(w), 5) AS w FROM (SELECT * FROM t UNION ALL SELECT dst, src, w FROM t) GROUP BY src, dst",
)
def cosine_neighbours(spark, sf_dir):  # noqa: ANN001, ANN201
    out = graphs.cosine_similarity(vectors(spark, sf_dir), "v", -1.0, 3, id_col="vec_id")
    return out.select("src", "dst", F.round("w", 5).alias("w"))


@query(
    "hamming_sim",
    "WITH c AS (SELECT s_suppkey AS pid, s_nationkey AS a, s_suppkey % 3 AS b, CAST(s_acctbal > 0 AS INTEGER) AS c FROM supplier), s AS (SELECT x.pid AS src, y.pid AS dst, "
    "CAST(CAST(x.a = y.a AS INTEGER) + CAST(x.b = y.b AS INTEGER) + CAST(x.c = y.c AS INTEGER) AS DOUBLE) AS w FROM c x JOIN c y ON x.pid <> y.pid) SELECT * FROM s WHERE w >= 2",
)
def hamming_sim(spark, sf_dir):  # noqa: ANN001, ANN201
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 3).alias("b"), (F.col("s_acctbal") > 0).cast("int").alias("c"))
    return graphs.hamming_similarity(s, ["a", "b", "c"], 2)


@query(
    "knn",
    f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST} AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM s) "
    "SELECT src, dst, 1.0::DOUBLE AS w FROM r WHERE r <= 2",
)
def knn(spark, sf_dir):  # noqa: ANN001, ANN201
    return graphs.knn_graph(vectors(spark, sf_dir), "v", 2, id_col="vec_id")


@query(
    "eps_graph",
    f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST} AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT src, dst, round(1 - d / 2, 5) AS w FROM s WHERE d < 1.18",
)
def eps_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    dist = graphs.distances(vectors(spark, sf_dir), "v", id_col="vec_id", max_dist=1.18)
    return graphs.epsilon_graph(dist, 1.18, lambda d: 1 - d / 2).select("src", "dst", F.round("w", 5).alias("w"))


@query(
    "linear_sim",
    f"WITH {_VECTORS}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST} AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id) "
    "SELECT src, dst, round(CASE WHEN greatest(0, 1 - least(d, 1.5) / 1.5) < 0.1 THEN 0 ELSE greatest(0, 1 - least(d, 1.5) / 1.5) END, 5) + 0.0 AS w FROM s",
)
def linear_sim(spark, sf_dir):  # noqa: ANN001, ANN201
    dist = graphs.distances(vectors(spark, sf_dir), "v", id_col="vec_id")
    return orders.linear_similarity(dist, 1.5, 0.1).select("src", "dst", (F.round("w", 5) + 0.0).alias("w"))


def _edge_query(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(customer_graph(spark, sf_dir)[0]).select("src", "dst", (F.round("w", 6) + 0.0).alias("w"))
    SQL[name] = f"WITH {_CUSTOMERS}, d AS (SELECT src AS node, sum(w) AS deg FROM e GROUP BY src), l AS (SELECT src, dst, -w AS w FROM e UNION ALL SELECT node, node, deg FROM d) {sql}"


_edge_query("laplacian", "SELECT src, dst, round(w, 6) + 0.0 AS w FROM l", graphs.laplacian)
_edge_query("norm_laplacian", "SELECT src, dst, round(w / sqrt(a.deg) / sqrt(b.deg), 6) + 0.0 AS w FROM l JOIN d a ON a.node = src JOIN d b ON b.node = dst", graphs.normalized_laplacian)
_edge_query("modularity", "SELECT src, dst, round(w - a.deg * b.deg / (SELECT sum(deg) FROM d), 6) + 0.0 AS w FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst", graphs.modularity)


@query("contract_graph", f"WITH {_CUSTOMERS} SELECT src % 4 AS src, dst % 4 AS dst, sum(w) AS w FROM e WHERE src % 4 <> dst % 4 GROUP BY 1, 2")
def contract_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    edges, points = customer_graph(spark, sf_dir)
    return graphs.contract(edges, points.select("pid", (F.col("pid") % 4).alias("bag")))


@query(
    "components",
    f"WITH RECURSIVE {_CUSTOMERS}, r AS (SELECT pid AS node, pid AS reach FROM p UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node",
)
def components(spark, sf_dir):  # noqa: ANN001, ANN201
    return graphs.connected_components(*[f(x) for f, x in zip((lambda e: e, lambda p: p.select(F.col("pid").alias("node"))), customer_graph(spark, sf_dir), strict=True)])


@query(
    "grid_graph",
    "WITH c AS (SELECT i // 7 AS r, i % 7 AS c, i FROM (SELECT unnest(range(35)) AS i)) SELECT a.i AS src, b.i AS dst, round(sqrt(power(a.r - b.r, 2) + power(a.c - b.c, 2)) / 2, 6) AS w FROM c a, c b "
    "WHERE a.i <> b.i AND power(a.r - b.r, 2) + power(a.c - b.c, 2) <= 4",
)
def grid_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    return generators.grid_graph(spark, (5, 7), 2, normalize=True).select("src", "dst", F.round("w", 6).alias("w"))


# -- scaling ---------------------------------------------------------------------------------
def _scaled(name: str, value: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), ["p_retailprice", "p_size"]).select(
        "p_partkey", *[(F.round(c, 5) + 0.0).alias(c) for c in ("p_retailprice", "p_size")]
    )
    SQL[name] = "SELECT p_partkey, " + ", ".join(f"round({value.replace('@', c)}, 5) + 0.0 AS {c.split('::')[0]}" for c in ("p_retailprice", "p_size::DOUBLE")) + " FROM part"


_scaled("standardize", "(@ - avg(@) OVER ()) / stddev_pop(@) OVER ()", scaling.standardize)
_scaled("balance", "@ - quantile_cont(@, 0.5) OVER ()", scaling.balance)
_scaled("unit_norm", "@ / sqrt(sum(@ * @) OVER ())", scaling.unit_columns)
QUERIES["standardize_rows"] = lambda spark, sf_dir: scaling.standardize_rows(
    read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c")), ["a", "b", "c"]
).agg(F.count("*").alias("n"), *[F.round(F.sum(F.abs(c)), 2).alias(c) for c in "abc"])
SQL["standardize_rows"] = (
    "WITH r AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem), m AS (SELECT a, b, c, (a + b + c) / 3 AS m FROM r), "
    "s AS (SELECT a, b, c, m, sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3) AS s FROM m) SELECT count(*) AS n, "
    + ", ".join(f"round(sum(abs(({c} - m) / CASE WHEN s = 0 THEN 1 ELSE s END)), 2) AS {c}" for c in "abc") + " FROM s"
)


# -- surveys ---------------------------------------------------------------------------------
def order_survey(spark: SparkSession, sf_dir: str) -> surveys.Survey:
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    variables = {
        "o_orderstatus": Variable("o_orderstatus", "nominal", "Status", {"F": "done", "O": "open"}, {"P": "partly"}),
        "o_orderpriority": Variable("o_orderpriority", "nominal", "Priority", {f"{k}": k for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")}, {"5-LOW": "low"}),
        "o_totalprice": Variable("o_totalprice", "numeric", "Price"),
    }
    return surveys.Survey(df, variables)


@query("complete_rows", "SELECT count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_totalprice IS NOT NULL) AS n FROM orders")
def complete_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    s = order_survey(spark, sf_dir)
    return s.df.agg(F.count_if(s.complete()).alias("n"))


@query("valid_per_row", "SELECT CAST(o_orderstatus <> 'P' AS INTEGER) + CAST(o_orderpriority <> '5-LOW' AS INTEGER) + CAST(o_totalprice IS NOT NULL AS INTEGER) AS n_valid, count(*) AS n FROM orders GROUP BY 1")
def valid_per_row(spark, sf_dir):  # noqa: ANN001, ANN201
    return order_survey(spark, sf_dir).valid_per_respondent().groupBy("n_valid").agg(F.count("*").alias("n"))


@query(
    "summarize",
    "SELECT 'o_totalprice' AS variable, round(min(o_totalprice), 2) AS min, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(max(o_totalprice), 2) AS max, count(o_totalprice) AS n_valid FROM orders",
)
def summarize(spark, sf_dir):  # noqa: ANN001, ANN201
    out = order_survey(spark, sf_dir).summarize("o_totalprice")
    return out.select("variable", *[F.round(c, 2).alias(c) for c in ("min", "mean", "median", "max")], "n_valid")


@query(
    "value_counts",
    "SELECT 'o_orderstatus' AS variable, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2 UNION ALL "
    "SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2",
)
def value_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return order_survey(spark, sf_dir).value_counts()


@query(
    "variable_info",
    "SELECT 'o_orderstatus' AS variable, count(*) FILTER (WHERE o_orderstatus <> 'P') AS num_valid_answers, count(DISTINCT o_orderstatus) AS num_unique_answers FROM orders UNION ALL "
    "SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority <> '5-LOW'), count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice) FROM orders",
)
def variable_info(spark, sf_dir):  # noqa: ANN001, ANN201
    return order_survey(spark, sf_dir).variable_info().select("variable", "num_valid_answers", "num_unique_answers")


@query("unique_answers", "SELECT count(DISTINCT c_mktsegment) AS n FROM customer")
def unique_answers(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), "c_mktsegment")
    return spark.createDataFrame([(surveys.Survey(df).unique_answers(),)], "n long")


@query("recode", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN -1 END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def recode(spark, sf_dir):  # noqa: ANN001, ANN201
    return order_survey(spark, sf_dir).replace_values("o_orderstatus").df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("labelled", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'partly' END AS status, count(*) AS n FROM orders GROUP BY 1")
def labelled(spark, sf_dir):  # noqa: ANN001, ANN201
    return order_survey(spark, sf_dir).labelled("o_orderstatus").groupBy(F.col("Status").alias("status")).agg(F.count("*").alias("n"))


@query("guess_values", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value, p_size > 3 AS valid FROM part")
def guess_values(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), "p_size")
    s = surveys.Survey(df).guess_types().guess_value_lists(invalid_range=surveys.IntervalUnion.of(float("-inf"), 3, False, True))
    v = s.variables["p_size"]
    return spark.createDataFrame([(str(x), True) for x in v.valid] + [(str(x), False) for x in v.invalid], "value string, valid boolean")


@query(
    "resample",
    "SELECT o_orderstatus, 400 AS n, true AS of_table, true AS spread, true AS repeated FROM orders GROUP BY 1",
)
def resample(spark, sf_dir):  # noqa: ANN001, ANN201
    """Draws by stratum: all are rows of the table, their mean price is near the stratum's (four
    deviations of the mean), and some come twice, as draws with replacement do."""
    s = order_survey(spark, sf_dir)
    drawn = s.resample("o_orderstatus", 400).df
    known = s.df.select("pid", F.struct("o_orderstatus", "o_orderpriority", "o_totalprice").alias("row"))
    own = drawn.join(known, "pid").withColumn("same", F.struct("o_orderstatus", "o_orderpriority", "o_totalprice") == F.col("row"))
    mean = s.df.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean"), F.stddev("o_totalprice").alias("dev"))
    got = own.groupBy("o_orderstatus").agg(F.count("*").cast("int").alias("n"), F.bool_and("same").alias("of_table"), F.avg("o_totalprice").alias("m"))
    # Of N rows about n * n / 2N come twice: as many draws as make that 50 for the largest stratum.
    rows = s.df.groupBy("o_orderstatus").count().agg(F.max("count").alias("n")).first()["n"] or 0
    many = max(400, ceil(10 * rows**0.5))
    twice = s.resample("o_orderstatus", many).df.groupBy("o_orderstatus").agg(F.count_distinct("pid").alias("d"))
    return got.join(mean, "o_orderstatus").join(twice, "o_orderstatus").select("o_orderstatus", "n", "of_table", (F.abs(F.col("m") - F.col("mean")) < 4 * F.col("dev") / 20).alias("spread"), (F.col("d") < many).alias("repeated"))


# -- iterative or numeric --------------------------------------------------------------------
#: Every choice of sides of the first three features has more than this share of the rows.
SMALL = 0.02
_CELLS = f"c AS (SELECT f0, f1, f2, count(*) AS n FROM f GROUP BY f0, f1, f2 HAVING count(*) >= (SELECT CAST(floor(count(*) * {SMALL}) AS BIGINT) FROM f))"


def _uncrossed(spark: SparkSession, sf_dir: str) -> uncross.UncrossingSweep:
    df = items(spark, sf_dir)
    return uncross.search_uncrossed(df, NAMES[:3], int(df.count() * SMALL))


@query("uncrossed_search", f"WITH {ITEMS}, {_CELLS} SELECT f0, f1, f2 FROM c")
def uncrossed_search(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sides that accords have of the first features: corners added between leave them as they
    are, one accord for each choice of sides that enough rows make."""
    found = _uncrossed(spark, sf_dir)
    order = [f for f in found.tree.features if f in found.first]
    rows = sorted({tuple(int(row[order.index(f)]) for f in range(3)) for row in found.matrix(only_first=True)})
    return spark.createDataFrame(rows, "f0 int, f1 int, f2 int")


@query("tree_of_accords", f"WITH {ITEMS}, {_CELLS} SELECT count(*) AS accords, count(*) - 1 AS edges, true AS tree, true AS nested FROM c")
def tree_of_accords(spark, sf_dir):  # noqa: ANN001, ANN201
    """Distinguishers that don't cross join the accords to a tree."""
    found = _uncrossed(spark, sf_dir)
    graph = found.tree_of_accords()
    nested = found.crossing() is None
    return spark.createDataFrame([(len(graph.matrix), len(graph.edges), graph.is_tree(), nested)], "accords long, edges long, tree boolean, nested boolean")


_CORNERS = [(a, oa, b, ob) for a in range(4) for b in range(a + 1, 4) for oa, ob in corners.CORNERS]


@query(
    "corner_features",
    f"WITH {ITEMS}, c AS (" + " UNION ALL ".join(f"SELECT 'inf({oa:+d} f{a}, {ob:+d} f{b})' AS feature, count(*) FILTER (WHERE least({oa} * f{a}, {ob} * f{b}) > 0) AS n FROM f" for a, oa, b, ob in _CORNERS)
    + ") SELECT feature FROM c WHERE least(n, (SELECT count(*) FROM f) - n) >= 0.1 * (SELECT count(*) FROM f)",
)
def corner_features(spark, sf_dir):  # noqa: ANN001, ANN201
    base = [features.Feature(n, F.col(n)) for n in NAMES[:4]]
    found = corners.corner_features(items(spark, sf_dir), base, 0.1, True, orders.order_balance)
    return spark.createDataFrame([(f.name,) for f in found], "feature string")


_STANDARD = "z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem), r AS (SELECT sign(sum(a * b)) AS s FROM z)"


@query(
    "pca_features",
    f"WITH {_STANDARD} SELECT round(sum(abs(a + s * b)), 1) AS pc0, round(sum(abs(a - s * b)), 1) AS pc1, count(*) FILTER (WHERE a + s * b > 0) AS positive FROM z, r",
)
def pca_features(spark, sf_dir):  # noqa: ANN001, ANN201
    """Of two standardised columns the leading vectors are their sum and difference."""
    df = scaling.standardize(row_ids(read(spark, sf_dir, "lineitem")).select("pid", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    out = graphs.pca_features(df, ["l_quantity", "l_extendedprice"], 2)
    return out.agg(*[F.round(F.sum(F.abs(c)), 1).alias(c) for c in ("pc0", "pc1")], F.count_if(F.col("pc0") > 0).alias("positive"))


@query(
    "minimize_cut",
    "WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, 1 + (a.n_nationkey + b.n_nationkey) % 3 AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), "
    "s AS (SELECT 0 AS k, (SELECT list(CASE WHEN n_nationkey >= 12 THEN 1 ELSE -1 END ORDER BY n_nationkey) FROM nation) AS f UNION ALL "
    "SELECT k + 1, list_transform(f, lambda v, i: CASE WHEN i = best.p + 1 THEN -v ELSE v END) FROM (SELECT k, f, (SELECT min({'c': c, 'p': src}) FROM "
    "(SELECT src, sum(w * f[src + 1] * f[dst + 1]) AS c FROM e GROUP BY src)) AS best FROM s) WHERE best.c < 0) "
    "SELECT n_nationkey AS pid, f[n_nationkey + 1] AS n1 FROM nation, (SELECT f FROM s ORDER BY k DESC LIMIT 1)",
)
def minimize_cut(spark, sf_dir):  # noqa: ANN001, ANN201
    n = read(spark, sf_dir, "nation")
    points = n.select(F.col("n_nationkey").alias("pid"), features.side(F.col("n_nationkey") >= 12).alias("n1"))
    near = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"))
    edges = near.select(
        F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"), (1 + (F.col("a.n_nationkey") + F.col("b.n_nationkey")) % 3).cast("double").alias("w")
    )
    return graphs.minimize_order(edges, points, "n1")


_VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_SAID = [("l_quantity", ">=", 26), ("l_extendedprice", ">=", 50000), ("l_discount", ">=", 0.05), ("l_tax", ">=", 0.04), ("l_returnflag", "==", "R"), ("l_linestatus", "==", "O")]


def item_survey(spark: SparkSession, sf_dir: str) -> tuple[surveys.Survey, list[features.Feature]]:
    """Line items as answers, with the six features and what they say."""
    df = row_ids(read(spark, sf_dir, "lineitem")).select("pid", *_VARIABLES)
    variables = {c: Variable(c, "numeric") for c in _VARIABLES[:4]}
    variables["l_returnflag"] = Variable("l_returnflag", "nominal", "", {"A": "A", "N": "N", "R": "R"})
    variables["l_linestatus"] = Variable("l_linestatus", "nominal", "", {"F": "F", "O": "O"})
    return surveys.Survey(df, variables), [features.Feature(c, features.side(F.expr(c)), i) for c, i in zip(CONDITIONS, _SAID, strict=True)]


def _answer(k: int, sign: str) -> str:
    c, op, v = _SAID[k]
    if op == ">=":
        return f"[{v}, inf)" if sign == "+" else f"(-inf, {v})"
    return {"R+": "R", "R-": "A, N", "O+": "O", "O-": "F"}[v + sign]


@query(
    "typical_answers",
    f"{_tree_sql()}, m6 AS (SELECT {_PATH.replace('path', 'n.path')} AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.level = n.level + 1 AND c.path[1:n.level] = n.path)) "
    + " UNION ALL ".join(
        f"SELECT path, '{c}' AS variable, CASE path[{k + 1}] WHEN '+' THEN '{_answer(k, '+')}' WHEN '-' THEN '{_answer(k, '-')}' ELSE '{'(-inf, inf)' if k < 4 else ('A, N, R' if k == 4 else 'F, O')}' END AS answers FROM m6"
        for k, c in enumerate(_VARIABLES)
    ),
)
def typical_answers(spark, sf_dir):  # noqa: ANN001, ANN201
    s, own = item_survey(spark, sf_dir)
    found = surveys.SurveyAccords(s, int(s.df.count() * SHARE), features=own, order=None)
    paths = [_text(tuple(int(x) for x in row if x)) for row in found.matrix()]
    rows = [(p, c, v) for p, a in zip(paths, found.typical_answers(), strict=True) for c, v in a.items()]
    return spark.createDataFrame(rows, "path string, variable string, answers string")
