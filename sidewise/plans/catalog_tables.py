"""Queries on survey tables, sources, graphs and streams."""
# ruff: noqa: ANN001, ANN201

from __future__ import annotations

from math import inf

import numpy as np
from pyspark.sql import functions as F

from ..functions import scaling
from ..functions.intervals import IntervalUnion
from ..operators import counts, features, graphs, orders, surveys
from ..sources import generators
from ..sources import surveys as files
from ..sources.surveys import Variable
from ..streaming import atoms as streams
from .catalog import _CUSTOMERS, _ITEMS, NAMES, POINT_FEATURES, customer_graph, items, order_survey, query, read
from .catalog_trees import _folder
from .uncross import AccordGraph

_COUNTED = (
    "SELECT 'o_orderstatus' AS variable, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2 UNION ALL "
    "SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2"
)


# -- sources ---------------------------------------------------------------------------------
@query("survey_saved", _COUNTED)
def survey_saved(spark, sf_dir):
    s, folder = order_survey(spark, sf_dir), _folder(spark, "survey")
    files.save(s.df, s.variables, folder, "orders")
    return surveys.Survey(*files.load(spark, folder, "orders")).value_counts()


@query(
    "sentinels",
    "SELECT coalesce(nullif(o_orderstatus, 'P'), 'NaN') AS status, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS missing, "
    "(SELECT least(min(o_totalprice), 0) - 1 FROM orders WHERE o_orderkey % 7 <> 0)::DOUBLE AS sentinel FROM orders GROUP BY 1",
)
def sentinels(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pid"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")
    )
    s = surveys.Survey(df).nulls_to_sentinels()
    gone = float(next(iter(s.variables["price"].invalid)))
    return s.df.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("price") == gone).alias("missing"), F.lit(gone).alias("sentinel"))


@query("labelled_file", "SELECT 'c_nationkey' AS variable, 'numeric' AS type, n_nationkey AS value, n_name AS label, n_nationkey NOT BETWEEN 20 AND 23 AND n_nationkey <> 7 AS valid FROM nation")
def labelled_file(spark, sf_dir):
    labels = {r["n_nationkey"]: r["n_name"] for r in read(spark, sf_dir, "nation").collect()}  # 25 rows
    v = files.from_labelled_file(["c_nationkey"], {}, {"c_nationkey": "scale"}, {"c_nationkey": labels}, {"c_nationkey": [(20, 23), (7, 7)]})["c_nationkey"]
    rows = [(v.name, v.type, k, x, ok) for part, ok in ((v.valid, True), (v.invalid, False)) for k, x in part.items()]
    return spark.createDataFrame(rows, "variable string, type string, value int, label string, valid boolean")


@query("from_matrix", "SELECT n_nationkey::BIGINT AS pid, n_regionkey::BIGINT AS f0, (n_nationkey % 3)::BIGINT AS f1 FROM nation")
def from_matrix(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return generators.from_matrix(spark, [(r["n_regionkey"], r["n_nationkey"] % 3) for r in rows])


@query(
    "from_sparse",
    "SELECT f0, f1, f2, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE -1 END AS f0, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE -1 END AS f1, "
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS f2 FROM orders) GROUP BY ALL",
)
def from_sparse(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("pid", F.col("o_orderkey"))
    on = {0: F.col("o_orderpriority") == "1-URGENT", 1: F.col("o_orderpriority") == "3-MEDIUM", 2: F.col("o_orderstatus") == "F"}
    entries = o.select("pid", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in on.items()]))).alias("col"))
    table = generators.from_sparse(entries, NAMES[:3], o)
    return table.groupBy(*[F.col(n).cast("int").alias(n) for n in NAMES[:3]]).agg(F.count("*").alias("n"))


@query("random_features", "SELECT CAST(unnest(range(4)) AS INTEGER) AS feature, count(*) AS n, true AS near, true AS apart FROM orders")
def random_features(spark, sf_dir):
    """Shares near 0.3, and pairs as independent as chance lets them be (five deviations)."""
    n = read(spark, sf_dir, "orders").count()
    df = generators.random_features(spark, 4, n, 0.3, seed=5)
    on = [F.when(F.col(f"f{i}") > 0, 1.0).otherwise(0.0) for i in range(4)]
    one = df.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(on)], *[F.avg(on[i] * on[(i + 1) % 4]).alias(f"b{i}") for i in range(4)])
    each = F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col("n"), (F.abs(F.col(f"m{i}") - 0.3) < 5 * (0.21 / n) ** 0.5).alias("near"), (F.abs(F.col(f"b{i}") - 0.09) < 5 * (0.0819 / n) ** 0.5).alias("apart"))
        for i in range(4)
    ])
    return one.select(F.explode(each).alias("s")).select("s.*")


@query("feature_kinds", "SELECT * FROM (VALUES ('items', 'feature'), ('two-sided', 'set'), ('prices', 'real')) t(name, kind)")
def feature_kinds(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    both = c.select(F.when(F.col("c_nationkey") < 3, 0).otherwise(features.side(F.col("c_acctbal") > 0)).alias("a"))
    kinds = {"items": (items(spark, sf_dir), NAMES), "two-sided": (both, ["a"]), "prices": (c, ["c_acctbal"])}
    return spark.createDataFrame([(k, generators.encoding(*x)) for k, x in kinds.items()], "name string, kind string")


@query("tsv", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand")
def tsv(spark, sf_dir):
    folder = _folder(spark, "tsv")
    read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").write.option("sep", "\t").option("header", True).csv(folder)
    out = files.read_tsv(spark, folder, "p_partkey long, p_brand string, p_size int")
    return out.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


# -- selections and edits --------------------------------------------------------------------
@query(
    "column_selections",
    "WITH c AS (SELECT column_name AS name, row_number() OVER () - 1 AS k FROM (DESCRIBE orders)) SELECT 'all' AS selection, name FROM c UNION ALL SELECT 'place', name FROM c WHERE k = 1 UNION ALL "
    "SELECT 'slice', name FROM c WHERE k BETWEEN 1 AND 3 UNION ALL SELECT 'mask', name FROM c WHERE k % 2 = 0 UNION ALL SELECT 'rule', name FROM c WHERE name LIKE 'o_order%' UNION ALL "
    "SELECT 'mixed', name FROM c WHERE k = 0 OR name = 'o_custkey'",
)
def column_selections(spark, sf_dir):
    names = read(spark, sf_dir, "orders").columns
    asked = {"all": None, "place": 1, "slice": slice(1, 4), "mask": [k % 2 == 0 for k in range(len(names))], "rule": lambda v: v.name.startswith("o_order"), "mixed": [0, "o_custkey"]}
    return spark.createDataFrame([(k, c) for k, s in asked.items() for c in files.resolve(names, s)], "selection string, name string")


@query("questions", "SELECT count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice, count(*) FILTER (WHERE o_totalprice > 1000) AS pricey FROM orders")
def questions(spark, sf_dir):
    s = order_survey(spark, sf_dir)
    part = s.select_questions(lambda v: v.label in ("Status", "Price"))
    pricey = s[["o_totalprice"]].where("o_totalprice > 1000").count()
    return part.df.agg(*[F.count(c).alias(c) for c in part.columns]).withColumn("pricey", F.lit(pricey).cast("long"))


@query(
    "respondents",
    "SELECT 'condition' AS how, count(*) AS n, round(sum(o_totalprice), 1) AS price FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'ids', count(*), round(sum(o_totalprice), 1) FROM orders WHERE o_orderkey IN (3, 5, 8, 13) UNION ALL "
    "SELECT 'mask', count(*), round(sum(o_totalprice), 1) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 5 = 2 UNION ALL "
    "SELECT 'rule', count(*), round(sum(o_totalprice), 1) FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '2-HIGH'",
)
def respondents(spark, sf_dir):
    s = order_survey(spark, sf_dir)
    n = s.df.count()
    asked = {
        "condition": F.col("o_orderstatus") == "F", "ids": [3, 5, 8, 13], "mask": [k % 5 == 2 for k in range(n)],
        "rule": lambda row: row["o_totalprice"] > 300000 and row["o_orderpriority"] == "2-HIGH",
    }
    out = None
    for how, selection in asked.items():
        one = s.select_respondents(selection).df.agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("price"))
        out = one if out is None else out.union(one)
    return out


_UNION = "(l_quantity >= 3 AND l_quantity < 10) OR (l_quantity > 20 AND l_quantity <= 30)"


@query(
    "interval_unions",
    f"SELECT 'union' AS what, count(*) FILTER (WHERE {_UNION}) AS n FROM lineitem UNION ALL SELECT 'rest', count(*) FILTER (WHERE NOT ({_UNION})) FROM lineitem UNION ALL "
    f"SELECT 'less', count(*) FILTER (WHERE ({_UNION}) AND NOT (l_quantity >= 25)) FROM lineitem UNION ALL SELECT 'either', count(*) FILTER (WHERE ({_UNION}) <> (l_quantity >= 25)) FROM lineitem",
)
def interval_unions(spark, sf_dir):
    u, high = IntervalUnion.of(3, 10, True, False) | IntervalUnion.of(20, 30, False, True), IntervalUnion.of(25, inf, True, False)
    made = {"union": u, "rest": ~u, "less": u - high, "either": u ^ high}
    one = read(spark, sf_dir, "lineitem").agg(*[F.count_if(x.column(F.col("l_quantity"))).alias(k) for k, x in made.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in made])).alias("s")).select("s.*")


@query(
    "check_survey",
    "SELECT 'o_orderstatus' AS variable, 'values that aren''t listed: [' || string_agg('''' || v || '''', ', ' ORDER BY v) || ']' AS problem FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) "
    "UNION ALL SELECT 'o_totalprice', 'no list of valid values' UNION ALL SELECT 'o_orderpriority', 'ordinal, but its values aren''t numbers'",
)
def check_survey(spark, sf_dir):
    s = order_survey(spark, sf_dir).set_values("o_orderstatus", {"F": "done", "O": "open"}, {}).set_types(["o_totalprice", "o_orderpriority"], ["nominal", "ordinal"])
    checked, problems = s.check()
    return spark.createDataFrame([(c, p) for c, p in problems.items() if not checked.variables[c].usable], "variable string, problem string")


@query(
    "guessed_types",
    "SELECT column_name AS variable, CASE WHEN column_type LIKE '%INT%' OR column_type LIKE 'TIMESTAMP%' THEN 'ordinal' WHEN column_type = 'DOUBLE' THEN 'numeric' ELSE 'nominal' END AS type FROM (DESCRIBE orders) WHERE column_name <> 'o_orderkey'",
)
def guessed_types(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "pid")
    return spark.createDataFrame([(c, v.type) for c, v in surveys.Survey(df).guess_types().variables.items()], "variable string, type string")


@query("edited_labels", "SELECT n_nationkey AS value, CASE WHEN n_regionkey = 0 THEN 'first ' || n_name ELSE n_name END AS label, n_regionkey <> 4 AS valid, 'Nation' AS variable, 'ordinal' AS type FROM nation")
def edited_labels(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").collect()  # 25 rows
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), "c_nationkey")
    names = {r["n_nationkey"]: r["n_name"] for r in nations}
    s = surveys.Survey(df).set_types("c_nationkey", "ordered").set_labels("c_nationkey", ["Nation"])
    s = s.set_values("c_nationkey", {k: x for k, x in names.items() if k % 5 != 4}, {k: x for k, x in names.items() if k % 5 == 4})
    s = s.set_value_labels("c_nationkey", {r["n_nationkey"]: "first " + r["n_name"] for r in nations if r["n_regionkey"] == 0}).rename({"c_nationkey": "nation"})
    v = s.variables["nation"]
    rows = [(k, x, ok, v.label, v.type) for part, ok in ((v.valid, True), (v.invalid, False)) for k, x in part.items()]
    return spark.createDataFrame(rows, "value int, label string, valid boolean, variable string, type string")


@query("merged_values", "SELECT CASE WHEN n_regionkey < 2 THEN 0 ELSE n_regionkey END AS value, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS label FROM nation GROUP BY 1")
def merged_values(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    v = Variable("n", "ordinal", "", {r["n_nationkey"]: r["n_name"] for r in rows})
    merged = v.replace_values({r["n_nationkey"]: 0 if r["n_regionkey"] < 2 else r["n_regionkey"] for r in rows})
    return spark.createDataFrame(list(merged.valid.items()), "value int, label string")


def _both(name: str, condition: str, bad: str) -> str:
    return f"SELECT '{name}' AS feature, count(*) FILTER (WHERE {condition} AND NOT {bad}) AS positive, count(*) FILTER (WHERE {condition} OR {bad}) AS ge_zero, count(*) FILTER (WHERE NOT ({condition}) OR {bad}) AS le_zero FROM o"


@query(
    "survey_features",
    "WITH o AS (SELECT *, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders) "
    + " UNION ALL ".join([
        _both("o_orderstatus == O", "o_orderstatus = 'O'", "(o_orderstatus = 'P')"),
        *[_both(f"o_orderpriority == {p}", f"o_orderpriority = '{p}'", "(o_orderpriority = '5-LOW')") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")],
        *[_both(f"price {s}", f"o_totalprice >= lo * (1 - {s} / 5.0::DOUBLE) + hi * ({s} / 5.0::DOUBLE)", "false") for s in range(1, 5)],
    ]),
)
def survey_features(spark, sf_dir):
    s = order_survey(spark, sf_dir)
    found = s.features()
    prices = iter(range(1, 5))
    found = [f.named(f"price {next(prices)}") if f.info[0] == "o_totalprice" else f for f in found]
    sides = counts.side_counts(s.df.select(*[f.column.alias(f"x{i}") for i, f in enumerate(found)]), [f"x{i}" for i in range(len(found))])
    label = F.create_map(*[F.lit(x) for i, f in enumerate(found) for x in (f"x{i}", f.name)])
    return sides.select(label[F.col("feature")].alias("feature"), "positive", "ge_zero", "le_zero")


@query("unit_rows", "SELECT count(*) AS n, round(sum(a / sqrt(a * a + b * b)), 3) AS a, round(sum(b / sqrt(a * a + b * b)), 3) AS b FROM (SELECT l_quantity AS a, l_discount * 100 + 1 AS b FROM lineitem)")
def unit_rows(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100 + 1).alias("b"))
    return scaling.unit_rows(df, ["a", "b"]).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in "ab"])


@query("balance_rows", "SELECT round(sum(abs(a - m)), 2) AS a, round(sum(abs(b - m)), 2) AS b, round(sum(abs(c - m)), 2) AS c FROM (SELECT *, list_median([a, b, c]) AS m FROM (SELECT l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem))".replace("list_median([a, b, c])", "list_sort([a, b, c])[2]"))
def balance_rows(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return scaling.balance_rows(df, ["a", "b", "c"]).agg(*[F.round(F.sum(F.abs(c)), 2).alias(c) for c in "abc"])


# -- graphs ----------------------------------------------------------------------------------
@query("order_five", f"WITH {_CUSTOMERS} " + " UNION ALL ".join(f"SELECT {i} AS feature, (SELECT 2 * coalesce(sum(w) FILTER (WHERE s{i} <> d{i}), 0) FROM j) AS value" for i in range(3)))
def order_five(spark, sf_dir):
    edges, points = customer_graph(spark, sf_dir)
    return orders.o_five(graphs.laplacian(edges))(points, POINT_FEATURES)


@query("order_seven", f"WITH {_CUSTOMERS} " + " UNION ALL ".join(f"SELECT {i} AS feature, CAST((SELECT sum(n{i} * (pid % 7 + 1)) FROM p) AS DOUBLE) AS value" for i in range(3)))
def order_seven(spark, sf_dir):
    """A diagonal matrix and its like: f'Jf of entries (i, i) adds up all weights whatever the
    side, so entries to a pole of side +1 are added, half in each direction."""
    _, points = customer_graph(spark, sf_dir)
    with_pole = points.union(spark.createDataFrame([(-1, 1, 1, 1)], points.schema))
    w = ((F.col("pid") % 7 + 1) / 2).cast("double").alias("w")
    entries = points.select(F.col("pid").alias("src"), F.lit(-1).cast("long").alias("dst"), w)
    return orders.o_seven(graphs.both_ways(entries))(with_pole, POINT_FEATURES)


@query(
    "logdet_order",
    f"WITH {_CUSTOMERS}, d AS (SELECT *, pid // 2 AS pair, 2 + pid % 5 AS own FROM p), s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS feature, pair, n{i} AS side, list(own) AS l FROM d GROUP BY pair, n{i}" for i in range(3))
    + ") SELECT feature, round(sum(CASE WHEN len(l) = 2 THEN ln(l[1] * l[2] - 0.25) ELSE ln(l[1]) END), 6) AS value FROM s GROUP BY feature",
)
def logdet_order(spark, sf_dir):
    """Pairs of customers are joined by 0.5, so the matrix has blocks of two."""
    _, points = customer_graph(spark, sf_dir)
    own = points.select(F.col("pid").alias("src"), F.col("pid").alias("dst"), (2 + F.col("pid") % 5).cast("double").alias("w"))
    last = points.agg(F.max("pid").alias("m")).first()["m"]
    other = F.when(F.col("pid") % 2 == 0, F.col("pid") + 1).otherwise(F.col("pid") - 1)
    off = points.select(F.col("pid").alias("src"), other.alias("dst"), F.lit(0.5).alias("w")).where(F.col("dst") <= last)
    return orders.log_determinant_order(own.union(off), points, POINT_FEATURES).select("feature", F.round("value", 6).alias("value"))


def _changed(name: str, kind: str, value: str) -> None:
    def run(spark, sf_dir):
        edges, points = customer_graph(spark, sf_dir)
        return orders.discrete_derivative(edges, points, "n1", kind=kind).select("pid", F.round(F.col("change") * 1e6, 0).alias("change"))

    sql = (
        f"WITH {_CUSTOMERS}, c AS (SELECT p.pid, p.n1, h.deg, coalesce(sum(w * s1 * d1), 0) AS x FROM p JOIN h USING (pid) LEFT JOIN j ON j.src = p.pid GROUP BY ALL), "
        "t AS (SELECT (SELECT coalesce(sum(w) FILTER (WHERE s1 <> d1), 0) / 2 FROM j) AS cut, count(*) AS n, count(*) FILTER (WHERE n1 > 0) AS a, sum(deg) AS vol, sum(deg) FILTER (WHERE n1 > 0) AS va FROM c) "
        f"SELECT pid, round(({value}) * 1e6, 0) + 0.0 AS change FROM c, t"
    )
    query(name, sql)(run)


_changed("derivative_ratio", "ratio", "(cut + x) * n / ((a - n1) * (n - a + n1)) - cut * n / (a * (n - a))")
_changed("derivative_normalised", "normalised", "(cut + x) * vol / ((va - n1 * deg) * (vol - va + n1 * deg)) - cut * vol / (va * (vol - va))")


@query(
    "nodal_domains",
    f"WITH RECURSIVE {_CUSTOMERS}, k AS (SELECT src, dst FROM j WHERE s1 = d1), r AS (SELECT pid AS node, pid AS reach FROM p UNION SELECT r.node, k.dst FROM r JOIN k ON k.src = r.reach), "
    "l AS (SELECT node, min(reach) AS domain FROM r GROUP BY node) SELECT p.n1 AS side, domain, count(*) AS n FROM l JOIN p ON p.pid = l.node GROUP BY ALL",
)
def nodal_domains(spark, sf_dir):
    edges, points = customer_graph(spark, sf_dir)
    values = points.select(F.col("pid").alias("node"), (F.col("n1") * 0.5).cast("double").alias("x"))
    return graphs.nodal_domains(edges, values).groupBy("side", "domain").agg(F.count("*").alias("n"))


@query(
    "min_cut",
    "WITH w AS (SELECT n_nationkey AS k, 2 + (n_nationkey * 7) % 24 AS w FROM nation WHERE n_nationkey < 24) SELECT CAST(n_nationkey AS BIGINT) AS node, CASE WHEN n_nationkey <= (SELECT arg_min(k, w) FROM w) THEN -1 ELSE 1 END AS side FROM nation",
)
def min_cut(spark, sf_dir):
    """Along a path the least edge is cut."""
    keys = sorted(r["n_nationkey"] for r in read(spark, sf_dir, "nation").collect())  # 25 rows
    edges = [(a, b, 2.0 + (min(a, b) * 7) % 24) for k in keys[:-1] for a, b in ((k, k + 1), (k + 1, k))]
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(graphs.min_cut(edges, len(keys), [keys[0]], [keys[-1]]))], "node long, side int")


_PATH_SIGN = "CASE WHEN cos(pi() * (@ + 0.5) / #) >= 0 THEN 1 ELSE -1 END"


@query("spectral_features", f"WITH n AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n) SELECT CAST(k AS INTEGER) AS node, 1 AS f0, {_PATH_SIGN.replace('@', 'k').replace('#', 'n')} AS f1 FROM (SELECT n, unnest(range(n)) AS k FROM n)")
def spectral_features(spark, sf_dir):
    """A path's second vector is a half wave. The path has a node for each nation and region."""
    n = read(spark, sf_dir, "nation").count() + read(spark, sf_dir, "region").count()
    a = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    signs = graphs.spectral_features(np.diag(a.sum(axis=1)) - a, 2)
    return spark.createDataFrame([(k, int(s[0]), int(s[1])) for k, s in enumerate(signs)], "node int, f0 int, f1 int")


@query(
    "spectral_by_component",
    "WITH c AS (SELECT c_custkey AS k, c_custkey // 10 * 10 AS c FROM customer) SELECT CAST(c AS VARCHAR) AS feature, k AS node, 1 AS v FROM c UNION ALL "
    f"SELECT c || ':0', k, {_PATH_SIGN.replace('@', '(k - c)').replace('#', '10')} FROM c",
)
def spectral_by_component(spark, sf_dir):
    """Paths of ten customers each."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"), F.lit(1.0).alias("w"))
    return graphs.spectral_features_by_component(graphs.both_ways(c.where("src % 10 <> 9")), c.count() // 10, 0.0)


@query(
    "greedy_neighbourhood",
    f"WITH RECURSIVE {_CUSTOMERS}, s AS (SELECT 0 AS k, CAST([5] AS BIGINT[]) AS l UNION ALL SELECT k + 1, list_append(l, best.p) FROM "
    "(SELECT k, l, (SELECT min({'w': -w, 'p': dst}) FROM (SELECT dst, sum(w) AS w FROM e WHERE list_contains(l, src) AND NOT list_contains(l, dst) GROUP BY dst)) AS best FROM s WHERE k < 8) WHERE best IS NOT NULL) "
    "SELECT CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place, unnest(l) AS node FROM (SELECT l FROM s ORDER BY k DESC LIMIT 1)",
)
def greedy_neighbourhood(spark, sf_dir):
    edges, _ = customer_graph(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(graphs.greedy_path(edges, 5, 9))), "place int, node long")


@query(
    "sparse_cosine",
    "WITH e AS (SELECT l_orderkey AS pid, l_partkey AS term, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), n AS (SELECT pid, sqrt(sum(x * x)) AS n FROM e GROUP BY pid) "
    "SELECT a.pid AS src, b.pid AS dst, round(sum(a.x * b.x) / any_value(p.n) / any_value(q.n), 6) AS w FROM e a JOIN e b ON a.term = b.term AND a.pid <> b.pid JOIN n p ON p.pid = a.pid JOIN n q ON q.pid = b.pid "
    "GROUP BY a.pid, b.pid HAVING sum(a.x * b.x) / any_value(p.n) / any_value(q.n) >= 0.87",
)
def sparse_cosine(spark, sf_dir):
    """Orders by the parts they ask for."""
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("term"), F.col("l_quantity").alias("x"))
    return graphs.sparse_cosine(entries, 0.87).select("src", "dst", F.round("w", 6).alias("w"))


@query(
    "hamming_strict",
    "WITH c AS (SELECT s_suppkey AS pid, s_nationkey AS a, s_suppkey % 3 AS b, CAST(s_acctbal > 0 AS INTEGER) AS c FROM supplier) SELECT x.pid AS src, y.pid AS dst, 3.0::DOUBLE AS w FROM c x JOIN c y ON x.pid <> y.pid AND x.a = y.a AND x.b = y.b AND x.c = y.c",
)
def hamming_strict(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 3).alias("b"), (F.col("s_acctbal") > 0).cast("int").alias("c"))
    return graphs.hamming_similarity(s, ["a", "b", "c"], 2, strict=True)


@query(
    "image_graph",
    "WITH p AS (SELECT n_nationkey AS k, n_nationkey // 5 AS r, n_nationkey % 5 AS c, (n_nationkey * 7) % 11 AS g FROM nation), e AS (SELECT a.k AS src, b.k AS dst, abs(a.g - b.g) AS d, sqrt(power(a.r - b.r, 2) + power(a.c - b.c, 2)) AS x "
    "FROM p a JOIN p b ON a.k <> b.k AND power(a.r - b.r, 2) + power(a.c - b.c, 2) <= 2), l AS (SELECT min(d) AS d0, max(d) AS d1, min(x) AS x0, max(x) AS x1 FROM e), "
    "w AS (SELECT src, dst, exp(-((d - d0) / (d1 - d0)) / 0.25) * exp(-((x - x0) / (x1 - x0)) / 4) AS w FROM e, l) SELECT src::BIGINT AS src, dst::BIGINT AS dst, round(w, 6) AS w FROM w WHERE w >= 0.1",
)
def image_graph(spark, sf_dir):
    pixels = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pixel_id"), (F.col("n_nationkey") * 7 % 11).alias("g"))
    out = graphs.image_graph(generators.grid_graph(spark, (5, 5), 1.5), pixels, ["g"], 0.5, 2, 0.1)
    return out.select("src", "dst", F.round("w", 6).alias("w"))


@query("minkowski", "SELECT a.s_suppkey AS src, b.s_suppkey AS dst, round(pow(pow(abs(a.s_nationkey - b.s_nationkey), 3) + pow(abs(a.s_suppkey % 7 - b.s_suppkey % 7), 3), 1 / 3.0::DOUBLE), 6) AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def minkowski(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 7).alias("y"))
    return orders.minkowski(s, ["x", "y"], 3).select("src", "dst", F.round("d", 6).alias("d"))


@query("ready_order", f"WITH {_CUSTOMERS} " + " UNION ALL ".join(f"SELECT '{o}' AS name, {i} AS feature, (SELECT coalesce(sum(w) FILTER (WHERE s{i} <> d{i}), 0) / 2 FROM j) AS value" for o in ("O5", "cut", "sim_cut") for i in range(3)))
def ready_order(spark, sf_dir):
    """Orders by name; three names of one."""
    edges, points = customer_graph(spark, sf_dir)
    out = None
    for name in ("O5", "cut", "sim_cut"):
        one = orders.create_order(name, edges)(points, POINT_FEATURES).select(F.lit(name).alias("name"), "feature", "value")
        out = one if out is None else out.union(one)
    return out


@query(
    "graph_of_accords",
    "SELECT a.n_regionkey AS src, b.n_regionkey AS dst, abs(a.n_regionkey - b.n_regionkey) AS steps FROM (SELECT DISTINCT n_regionkey FROM nation) a, (SELECT DISTINCT n_regionkey FROM nation) b",
)
def graph_of_accords(spark, sf_dir):
    """Distances in the graph of accords that thresholds on a line part: a path."""
    n = read(spark, sf_dir, "nation").agg(F.count_distinct("n_regionkey").alias("n")).first()["n"]
    matrix = np.array([[1 if r > t else -1 for t in range(n - 1)] for r in range(n)], np.int8)
    graph = AccordGraph.build(matrix, list(range(n - 1)), lambda a, b: a[1] == b[1] and (a[0] - b[0]) * a[1] >= 0)
    rows = [(a, b, d) for a in range(n) for b, d in graph.distances(a).items()]
    if not graph.is_tree() or any(len(graph.shortest_path(a, b)) != d + 1 for a, b, d in rows):
        raise AssertionError("the accords of a line are a path")
    return spark.createDataFrame(rows, "src int, dst int, steps int")


# -- streams ---------------------------------------------------------------------------------
@query("streamed_atoms", f"WITH f AS (SELECT {_ITEMS} FROM lineitem) SELECT f0, f1, f2, f3, f4, f5, CAST(count(*) AS BIGINT) AS w FROM f GROUP BY ALL")
def streamed_atoms(spark, sf_dir):
    """The table as a stream of files; counts of all micro-batches add up."""
    folder = _folder(spark, "stream")
    items(spark, sf_dir).select(*NAMES).repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.maintain(stream, NAMES, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return streams.current(spark, NAMES, f"{folder}/out").select(*[F.col(n).cast("int").alias(n) for n in NAMES], "w")
