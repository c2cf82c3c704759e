"""Operators on survey tables: selection, editing, summaries, features, and answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from math import inf
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import IntervalUnion
from ..functions.ordering import numbered, quantiles
from ..sources.surveys import Variable, resolve, sentinel_for, type_name
from ..sources.storage import stored
from . import features as ft
from .graphs import cosine_similarity


class Survey:
    """A table with a row for each respondent (``id_col``) and what is known of its variables.
    Nulls stay nulls and count as invalid; nothing is computed before it is asked for."""

    def __init__(self, df: DataFrame, variables: Mapping[str, Variable] | None = None, id_col: str = "pid") -> None:
        self.df, self.id_col = df, id_col
        self.columns = [c for c in df.columns if c != id_col]
        given = variables or {}
        self.variables = {c: given.get(c, Variable(c)) for c in self.columns}

    def _with(self, df: DataFrame | None = None, variables: Mapping[str, Variable] | None = None) -> Survey:
        return Survey(self.df if df is None else df, self.variables if variables is None else variables, self.id_col)

    def select(self, selection: Any = None) -> list[str]:
        return resolve(self.columns, selection, self.variables)

    def __getitem__(self, selection: Any) -> DataFrame:
        return self.df.select(self.id_col, *self.select(selection))

    def nulls_to_sentinels(self) -> Survey:
        """Nulls (and NaN) replaced by a value of their own that is registered as invalid."""
        df, variables = self.df, dict(self.variables)
        for c in self.columns:
            gone = F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, T.FractionalType) else F.lit(False))
            if not df.where(gone).isEmpty():
                value = sentinel_for(df, c, variables[c])
                df = df.withColumn(c, F.when(gone, F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)))
                variables[c] = variables[c].add_values(invalid={value: "NaN"})
        return self._with(df, variables)

    # -- rows and columns -------------------------------------------------------------------
    def select_questions(self, selection: Any = None) -> Survey:
        names = self.select(selection)
        return Survey(self.df.select(self.id_col, *names), {c: self.variables[c] for c in names}, self.id_col)

    def select_respondents(self, selection: Column | Sequence[Any] | Callable[[Mapping[str, Any]], bool]) -> Survey:
        """Rows by a condition, by ids, by a mask (truth values in the order of ids, as many as
        there are rows), or by a function of a row as a mapping."""
        if isinstance(selection, Column):
            return self._with(self.df.where(selection))
        if callable(selection):
            names = self.df.columns

            def run(batches):  # noqa: ANN001, ANN202
                for batch in batches:
                    rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
                    yield batch.filter(pa.array([bool(selection(dict(zip(names, r, strict=True)))) for r in rows], pa.bool_()))

            return self._with(self.df.mapInArrow(run, self.df.schema))
        items = [x.item() if isinstance(x, np.generic) else x for x in selection]
        spark = self.df.sparkSession
        if items and all(isinstance(x, bool) for x in items):
            places = spark.createDataFrame([(k,) for k, on in enumerate(items) if on], "__place long")
            if self.df.count() != len(items):
                raise ValueError(f"{len(items)} marks for another number of rows")
            return self._with(numbered(self.df, [self.id_col], "__place").join(places, "__place", "left_semi").select(self.df.columns))
        if not items:
            return self._with(self.df.limit(0))
        wanted = spark.createDataFrame([(x,) for x in dict.fromkeys(items)], [self.id_col])
        wanted = wanted.select(F.col(self.id_col).cast(self.df.schema[self.id_col].dataType))
        return self._with(self.df.join(wanted, self.id_col, "left_semi").select(self.df.columns))

    def valid(self, col: str) -> Column:
        bad = list(self.variables[col].invalid)
        ok = F.col(col).isNotNull()
        return ok & ~F.col(col).isin(bad) if bad else ok

    def complete(self) -> Column:
        return reduce(Column.__and__, [self.valid(c) for c in self.columns], F.lit(True))

    def valid_per_respondent(self) -> DataFrame:
        n = sum((self.valid(c).cast("int") for c in self.columns), F.lit(0))
        return self.df.select(self.id_col, n.alias("n_valid"))

    def resample(self, col: str, n: int = 1000, ranges: Sequence[IntervalUnion] | None = None, seed: int = 0) -> Survey:
        """``n`` rows of each value (of each range) drawn with replacement. A stratum's rows are
        numbered through and drawn by number, so no stratum has to fit anywhere at once."""
        if ranges is None and self.variables[col].type == "numeric":
            raise ValueError("ranges are needed for a numeric variable")
        stratum = F.col(col).cast("string") if ranges is None else reduce(
            lambda rest, kr: F.when(kr[1].column(F.col(col)), F.lit(str(kr[0]))).otherwise(rest), list(enumerate(ranges))[::-1], F.lit(None).cast("string")
        )
        span = F.pmod(F.xxhash64(F.lit(seed), self.id_col), F.lit(256))
        rows = self.df.withColumn("__s", stratum).where("__s IS NOT NULL AND " + ("true" if ranges is not None else f"`{col}` IS NOT NULL")).withColumn("__p", span)
        counts = rows.groupBy("__s", "__p").agg(F.count("*").alias("__c"))
        before = F.sum("__c").over(Window.partitionBy("__s").orderBy("__p")) - F.col("__c")
        counts = counts.withColumn("__b", before)
        sizes = counts.groupBy("__s").agg(F.sum("__c").alias("__n"))
        own = F.row_number().over(Window.partitionBy("__s", "__p").orderBy(self.id_col))
        numbered = rows.withColumn("__r", own).join(counts.drop("__c"), ["__s", "__p"]).withColumn("__k", F.col("__b") + F.col("__r") - 1)
        draws = sizes.select("__s", "__n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("__d"))
        draws = draws.withColumn("__k", F.pmod(F.xxhash64(F.lit(seed), "__s", "__d"), F.col("__n")))
        return self._with(draws.join(numbered, ["__s", "__k"]).select(self.df.columns))

    # -- summaries --------------------------------------------------------------------------
    def summarize(self, selection: Any = None) -> DataFrame:
        """``variable, type, label, min, mean, median, max, n_valid``: statistics of valid values
        of variables that aren't nominal. Medians are found first, by passes of counts; the rest is
        one pass."""
        each, names = [], self.select(selection)
        numbers = [c for c in names if self.variables[c].type in ("numeric", "ordinal")]
        valid = {c: F.when(self.valid(c), F.col(c).cast("double")) for c in numbers}
        medians = quantiles(self.df.select(*[x.alias(c) for c, x in valid.items()]), numbers) if numbers else {}
        for c in names:
            v = self.variables[c]
            x = valid.get(c, F.lit(None).cast("double"))
            each.append(F.struct(
                F.lit(c).alias("variable"), F.lit(v.type).cast("string").alias("type"), F.lit(v.label).alias("label"), F.min(x).alias("min"), F.avg(x).alias("mean"),
                F.lit(medians.get(c)).cast("double").alias("median"), F.max(x).alias("max"), F.count_if(self.valid(c)).alias("n_valid"),
            ))
        return _rows(self.df, each)

    def value_counts(self, selection: Any = None) -> DataFrame:
        """``variable, value, n`` for valid values of variables that aren't numeric."""
        names = [c for c in self.select(selection) if self.variables[c].type != "numeric"]
        each = F.array(*[F.struct(F.lit(c).alias("variable"), F.when(self.valid(c), F.col(c).cast("string")).alias("value")) for c in names])
        return self.df.select(F.explode(each).alias("s")).select("s.*").where("value IS NOT NULL").groupBy("variable", "value").agg(F.count("*").alias("n"))

    def variable_info(self, selection: Any = None) -> DataFrame:
        each = [
            F.struct(
                F.lit(c).alias("variable"), F.lit(self.variables[c].type).cast("string").alias("type"), F.lit(self.variables[c].label).alias("label"),
                F.count_if(self.valid(c)).alias("num_valid_answers"), F.count_distinct(c).alias("num_unique_answers"),
            )
            for c in self.select(selection)
        ]
        return _rows(self.df, each)

    def unique_answers(self, selection: Any = None) -> dict[str, int] | int:
        names = self.select(selection)
        r = self.df.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
        return r[names[0]] if len(names) == 1 else {c: r[c] for c in names}

    def check(self) -> tuple[Survey, dict[str, str]]:
        """Problems by variable; those that have one are marked unusable. Of all variables the
        values outside their lists are looked for in one pass, and a few of each are told."""
        problems: dict[str, str] = {}
        listed = [c for c in self.columns if self.variables[c].type in ("ordinal", "nominal") and self.variables[c].valid]
        found: dict[str, list[str]] = {}
        if listed:
            each = [
                F.when(~F.col(c).isin([*self.variables[c].valid, *self.variables[c].invalid]), F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")))
                for c in listed
            ]
            strange = self.df.select(F.explode(F.array_compact(F.array(*each))).alias("s")).select("s.*").groupBy("variable", "value").agg(F.lit(1))
            # Distinct values meet by variable and hash before the smallest few do.
            few = Window.partitionBy("variable", "part").orderBy("value")
            strange = strange.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("r", F.row_number().over(few)).where("r <= 5")
            for r in strange.select("variable", "value").collect():
                found.setdefault(r["variable"], []).append(r["value"])
            found = {c: sorted(values)[:5] for c, values in found.items()}
        for c in self.columns:
            v, number = self.variables[c], isinstance(self.df.schema[c].dataType, T.NumericType)
            if v.type not in ("numeric", "ordinal", "nominal"):
                problems[c] = "unknown type"
            elif v.type == "numeric" and not number:
                problems[c] = "numeric, but its values aren't numbers"
            elif v.type == "ordinal" and not number:
                problems[c] = "ordinal, but its values aren't numbers"
            elif v.type != "numeric" and not v.valid:
                problems[c] = "no list of valid values"
            elif v.type != "numeric" and len(v.valid) < 2:
                problems[c] = "fewer than two valid values"
            elif found.get(c):
                problems[c] = f"values that aren't listed: {found[c]}"
        return self._with(variables={c: replace(v, usable=c not in problems) for c, v in self.variables.items()}), problems

    # -- editing ----------------------------------------------------------------------------
    def replace_values(
        self, selection: Any = None, mapping: Mapping[Any, Any] | Sequence[Any] | None = None, change_type_to: str | None = None, combine_labels: bool = True
    ) -> Survey:
        """Remap values and lists. None: 1, 2, … for valid values in their order and -1, -2, …
        for invalid ones; a list: its place from 1 on. Labels of merged values are joined."""
        columns, variables = {}, dict(self.variables)
        for c in self.select(selection):
            v = variables[c].sorted()
            if mapping is None:
                m = {x: k for k, x in enumerate(v.valid, 1)} | {x: -k for k, x in enumerate(v.invalid, 1)}
            elif isinstance(mapping, Mapping):
                m = dict(mapping)
            else:
                m = {x: k for k, x in enumerate(mapping, 1)}
            columns[c] = _mapped(F.col(c), m, self.df.schema[c].dataType)
            variables[c] = replace(v.replace_values(m, combine_labels), type=change_type_to or v.type)
        return self._with(self.df.withColumns(columns), variables)

    def _edit(self, selection: Any, change: Callable[[Variable, int], Variable]) -> Survey:
        new = dict(self.variables)
        for k, c in enumerate(self.select(selection)):
            new[c] = change(new[c], k)
        return self._with(variables=new)

    def set_value_labels(self, selection: Any, labels: Mapping[Any, str]) -> Survey:
        return self._edit(selection, lambda v, k: v.with_labels(labels))

    def set_labels(self, selection: Any, labels: Sequence[str]) -> Survey:
        return self._edit(selection, lambda v, k: replace(v, label=labels[k]))

    def set_types(self, selection: Any, kind: str | Sequence[str]) -> Survey:
        return self._edit(selection, lambda v, k: replace(v, type=type_name(kind if isinstance(kind, str) else kind[k])))

    def set_values(self, selection: Any, valid: Mapping[Any, str] | None = None, invalid: Mapping[Any, str] | None = None) -> Survey:
        return self._edit(selection, lambda v, k: v.set_values(valid, invalid))

    def rename(self, names: Mapping[str, str]) -> Survey:
        new = {names.get(c, c): replace(v, name=names.get(c, c)) for c, v in self.variables.items()}
        return self._with(self.df.withColumnsRenamed(dict(names)), new)

    def guess_types(self, selection: Any = None, integers_ordinal: bool = True) -> Survey:
        """By column type; fractions that are all whole numbers count as integers."""
        names = [c for c in self.select(selection) if type_name(self.variables[c].type) is None]
        real = [c for c in names if isinstance(self.df.schema[c].dataType, T.FractionalType)]
        whole = self.df.agg(*[F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(False)).alias(c) for c in real]).first() if real else {}

        def kind(v: Variable, _: int) -> Variable:
            t = self.df.schema[v.name].dataType
            integral = isinstance(t, T.IntegralType) or v.name in real and whole[v.name]
            guess = (
                "nominal" if isinstance(t, T.BooleanType) else ("ordinal" if integers_ordinal else "nominal") if integral
                else "numeric" if isinstance(t, T.FractionalType | T.DecimalType) else "ordinal" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "nominal"
            )
            return replace(v, type=guess)

        return self._edit(names, kind)

    def guess_value_lists(self, selection: Any = None, invalid_range: IntervalUnion = IntervalUnion.of(-inf, 0), mark: bool = True, overwrite: bool = False) -> Survey:
        """Distinct values as lists, numbers in ``invalid_range`` as invalid ones."""
        def guess(v: Variable, _: int) -> Variable:
            if v.valid and not overwrite or v.type == "numeric":
                return v
            star = "(*)" if mark else ""
            values = ft.distinct_values(self.df, v.name)
            bad = {x for x in values if isinstance(x, int | float) and not isinstance(x, bool) and x in invalid_range}
            base = replace(v, valid={}, invalid={}) if overwrite else v
            return base.add_values({x: f"{x}{star}" for x in values if x not in bad}, {x: f"{x}{star}" for x in bad})

        return self._edit(selection, guess)

    def labelled(self, selection: Any = None) -> DataFrame:
        """Values and column names replaced by their labels."""
        out = [F.col(self.id_col)]
        for c in self.select(selection):
            v = self.variables[c]
            labels = {**v.valid, **v.invalid}
            text = F.col(c).cast("string")
            out.append((F.coalesce(_mapped(F.col(c), labels, T.StringType()), text) if labels else text).alias(v.label or c))
        return self.df.select(*out)

    # -- features ---------------------------------------------------------------------------
    def features(self, selection: Any = None, invalid: str = "both", num_bins: int = 5, max_extensive: int = 50, choose: Mapping[str, Callable[[Survey, str], list[ft.Feature]]] | None = None) -> list[ft.Feature]:
        """Features of variables by type. ``invalid`` values: "ignore" (on the negative side),
        "both" sides (0), "own" (an extra feature first), or "implicit" (one-hot or bins with
        invalid values as values). ``choose``: functions for single columns."""
        out: list[ft.Feature] = []
        for c in self.select(selection):
            v = self.variables[c]
            bad = list(v.invalid)
            if choose and c in choose:
                found = choose[c](self, c)
            elif v.type == "numeric":
                find = ft.regular_bins if invalid == "implicit" else None
                found = find(self.df, c, num_bins, bad) if find else ft.regular_ge(self.df, c, num_bins, max_extensive, bad)
            elif v.type == "ordinal" and invalid != "implicit":
                found = ft.ge_splits(self.df, c, bad)
            else:
                found = ft.one_hot(self.df, c, () if invalid == "implicit" else bad)
            if invalid == "both":
                found = ft.invalid_to_both_sides(found, c, bad)
            elif invalid == "own" and bad:
                found = [ft.invalid_feature(c, bad), *found]
            out += [replace(f, info=(c, *f.info)) for f in found]
        return out


def _mapped(col: Column, mapping: Mapping[Any, Any], kind: T.DataType) -> Column:
    """Values replaced by a mapping; others stay if they have the result's type."""
    if not mapping:
        return col
    number = all(isinstance(x, int | float) for x in mapping.values())
    text = isinstance(kind, T.StringType) and any(isinstance(k, str) for k in mapping)
    out = None
    for k, x in mapping.items():
        value = F.lit(x) if number else F.lit(str(x))
        out = F.when(col == F.lit(k), value) if out is None else out.when(col == F.lit(k), value)
    rest = col if number != text or not number else F.expr("NULL")
    return out.otherwise(rest if number else col.cast("string"))


def _rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    one = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(structs)])
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


# -- what accords say about answers ----------------------------------------------------------
def possible_values(variable: Variable, constraints: Sequence[tuple[str, Any]]) -> set | IntervalUnion:
    """What remains of a variable's values under constraints in turn. ``==`` starts anew with its
    value, whatever was excluded before."""
    if variable.type == "numeric":
        rest = IntervalUnion()
        for op, x in constraints:
            rest = IntervalUnion.of(x, x, True, True) if op == "==" else rest & _interval(op, x)
        return rest
    left = set(variable.valid)
    for op, x in constraints:
        if op == "==":
            left = {x}
        elif op in ("in", "not in"):
            left = {v for v in left if (v in _interval("in", x)) == (op == "in")}
        else:
            left = {v for v in left if {"!=": v != x, "<": v < x, "<=": v <= x, ">": v > x, ">=": v >= x}[op]}
    return left


def _interval(op: str, x: Any) -> IntervalUnion:
    if op in ("in", "not in"):
        out = IntervalUnion.of(*x)
        return out if op == "in" else ~out
    if op == "!=":
        return ~IntervalUnion.of(x, x, True, True)
    return IntervalUnion.of(x, inf, op == ">=") if op in (">", ">=") else IntervalUnion.of(-inf, x, False, op == "<=")


def typical_answers(
    survey: Survey, features: Sequence[ft.Feature], matrix: np.ndarray, levels: Sequence[int], only_affected: bool = True, labels: bool = False,
    selection: Any = None, extract_const: bool = False, only_max_level: bool = False,
) -> list[dict[str, str]] | tuple[list[dict[str, str]], dict[str, str]]:
    """For each accord the remaining values of each variable, as text; corners have no single
    variable and say nothing here. ``only_affected``: only variables that some feature in use is
    about. ``selection``: only these variables. ``only_max_level``: only accords with a side of
    every feature in use. ``extract_const``: also, apart, the answers that all accords share."""
    matrix = np.asarray(matrix)
    if only_max_level and matrix.size:
        matrix = matrix[matrix[:, -1] != 0]
    infos = [features[f].info for f in list(levels)[: matrix.shape[1] if matrix.ndim == 2 else 0]]
    infos = [i if isinstance(i, tuple) and len(i) == 3 and i[0] in survey.variables else None for i in infos]
    names = survey.select(selection)
    if only_affected:
        used = {i[0] for i in infos if i}
        names = [c for c in names if c in used]
    out = []
    for row in matrix:
        by: dict[str, list[tuple[str, Any]]] = {c: [] for c in names}
        for info, s in zip(infos, row, strict=False):
            if s and info and info[0] in by:
                c, op, x = info
                by[c].append((op if s > 0 else ft.INVERSE[op], x))
        answers = {}
        for c, found in by.items():
            rest = possible_values(survey.variables[c], found)
            if isinstance(rest, set):
                known = survey.variables[c].valid
                answers[c] = ", ".join(str(known.get(x, x)) if labels else str(x) for x in sorted(rest, key=str))
            else:
                answers[c] = str(rest)
        out.append({f"{survey.variables[c].label or c}[{c}]": x for c, x in answers.items()} if labels else answers)
    if not extract_const:
        return out
    const = {c: x for c, x in (out[0] if out else {}).items() if all(a[c] == x for a in out)}
    return [{c: x for c, x in a.items() if c not in const} for a in out], const


def explain(feature: ft.Feature, side: int, known: Mapping[str, ft.Feature]) -> list[list[tuple[str, str, Any]]]:
    """What a side says: alternatives of constraints ``(variable, operator, value)``."""
    info = feature.info
    if isinstance(info, tuple) and info and info[0] == "inf":
        parts = [explain(known[n], o * side, known) for n, o in info[1:]]
        if side > 0:  # all of them
            return [a + b for a in parts[0] for b in parts[1]]
        return parts[0] + parts[1]
    c, op, x = info
    return [[(c, op if side > 0 else ft.INVERSE[op], x)]]


class SurveyAccords:
    """A search over a survey that can be asked again with another agreement.

    ``features``: ready ones instead of those of ``factory`` (a function of the survey; default:
    ``Survey.features`` with ``invalid``). ``order``: the name of an order, a function of a table
    and its features, positions in a row, or None (as listed; with ``similarity`` by cut weight).
    Orders of graphs need ``similarity``, edges between respondents; without it the cosines of the
    numeric answers are taken, from 0.25 on and for at most 50 neighbours each. ``uncross``: make
    efficient distinguishers nested; needs an order with a name or a function."""

    def __init__(
        self, survey: Survey, agreement: float, selection: Any = None, invalid: str = "both", order: Any = "O2", max_features: int | None = None,
        features: Sequence[ft.Feature] | None = None, factory: Callable[[Survey], Sequence[ft.Feature]] | None = None,
        similarity: DataFrame | None = None, uncross: bool = False,
    ) -> None:
        from ..plans.search import search
        from ..plans.uncross import search_uncrossed
        from .orders import create_order, works_on_features

        self.survey, self.agreement, self.similarity = survey, agreement, similarity
        if features is None:
            features = factory(survey) if factory else survey.features(selection, invalid)
        self.features = list(features)
        self.names = [f"f{i}" for i in range(len(self.features))]
        table = ft.matrix(survey.df, [f.named(n) for f, n in zip(self.features, self.names, strict=True)], survey.id_col)
        table = stored(table, "features")
        if order is None and similarity is not None:
            order = "cut"
        if isinstance(order, str):
            if not works_on_features(order) and self.similarity is None:
                self.similarity = self._cosines()
            ranked = create_order(order, self.similarity, survey.id_col)
        else:
            ranked = order
        self.uncrossed = uncross
        if uncross:
            if not callable(ranked):
                raise ValueError("uncrossing needs an order function")
            self.search = search_uncrossed(table, self.names, agreement, order if isinstance(order, str) else ranked, max_features, self.similarity, survey.id_col)
        else:
            self.search = search(table, self.names, agreement, max_features, ranked)
        self.table = table

    def _cosines(self) -> DataFrame:
        s = self.survey
        numbers = [c for c in s.columns if isinstance(s.df.schema[c].dataType, T.NumericType)]
        if not numbers:
            raise ValueError("an order of a graph needs edges: no answer is a number")
        vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers])
        most = min(max(s.df.count() // 5, 1), 50)
        return stored(cosine_similarity(s.df.select(s.id_col, vector.alias("v")), "v", 0.25, most, id_col=s.id_col), "similarity")

    def change_agreement(self, agreement: float, force: bool = True) -> None:
        """Higher ones read the same tree; lower ones resume the search, or are an error without
        ``force``."""
        if agreement <= self.lower_bound():
            if not force:
                raise ValueError(f"below {self.lower_bound()} the search has to be resumed")
            self.search.lower_agreement(agreement)
        self.agreement = agreement

    def lower_bound(self) -> float:
        """From above this agreement on the tree answers without a search."""
        return self.search.tree.limit()

    def save(self, folder: str | None = None, timestamp: bool = False) -> str:
        """The tree, the features' columns and what they say; returns the folder (default
        ``survey.accords``, with the time if asked for). Corners of an uncrossed search are made
        anew, so such a search isn't saved."""
        from datetime import datetime

        folder = folder or "survey.accords"
        if timestamp:
            folder = f"{folder}-{datetime.now():%Y%m%d-%H%M%S}"
        if self.uncrossed:
            raise ValueError("an uncrossed search is searched again, not saved")
        spark = self.survey.df.sparkSession
        self.search.tree.save(spark, f"{folder}/tree")
        self.table.write.mode("overwrite").parquet(f"{folder}/features")
        rows = [(k, f.name, repr(f.info), float(self.agreement)) for k, f in enumerate(self.features)]
        spark.createDataFrame(rows, "feature int, name string, info string, agreement double").write.mode("overwrite").parquet(f"{folder}/meta")
        return folder

    @staticmethod
    def load(survey: Survey, folder: str) -> SurveyAccords:
        """Saved accords of a survey; features keep their columns' values."""
        from ast import literal_eval

        from ..plans.search import Search
        from ..plans.tree import AccordTree

        spark = survey.df.sparkSession
        out = SurveyAccords.__new__(SurveyAccords)
        meta = spark.read.parquet(f"{folder}/meta").orderBy("feature").collect()
        out.survey, out.agreement, out.similarity, out.uncrossed = survey, meta[0]["agreement"] if meta else 0, None, False
        out.names = [f"f{r['feature']}" for r in meta]
        out.features = [ft.Feature(r["name"], F.col(n), literal_eval(r["info"])) for r, n in zip(meta, out.names, strict=True)]
        out.table = spark.read.parquet(f"{folder}/features")
        out.search = Search(out.table, out.names)
        out.search.sweep.tree = AccordTree.load(spark, f"{folder}/tree")
        return out

    def matrix(self, remove_prefixes: bool = False, remove_duplicates: bool = False) -> np.ndarray:
        """A row for each accord, a column for each feature in use (without the corners that
        uncrossing made)."""
        from .analysis import without_prefixes

        m = self.search.matrix(self.agreement, only_first=True) if self.uncrossed else self.search.matrix(self.agreement)
        if remove_duplicates and len(m):
            m = m[np.sort(np.unique(m, axis=0, return_index=True)[1])]
        return without_prefixes(m) if remove_prefixes else m

    def levels(self) -> list[int]:
        """The feature of each column of the matrix."""
        found = self.search.tree.features
        return [f for f in found if f in self.search.first] if self.uncrossed else list(found)

    def specified(self) -> list[int]:
        """Features of which some accord has a side."""
        m = self.matrix()
        return [f for k, f in enumerate(self.levels()) if k < m.shape[1] and (m[:, k] != 0).any()]

    def metadata(self) -> list[Any]:
        """What each column of the matrix says."""
        return [self.features[f].info for f in self.levels()]

    def metadata_table(self) -> DataFrame:
        """``level, feature, variable, operator, value`` of the features in use, by levels."""
        rows = []
        for k, f in enumerate(self.levels()):
            info = self.features[f].info
            known = info if isinstance(info, tuple) and len(info) == 3 else (None, None, None)
            rows.append((k, f, *[None if x is None else str(x) for x in known]))
        return self.survey.df.sparkSession.createDataFrame(rows, "level int, feature int, variable string, operator string, value string")

    def typical_answers(
        self, only_affected: bool = True, labels: bool = False, selection: Any = None, extract_const: bool = False, only_max_level: bool = False
    ) -> list[dict[str, str]] | tuple[list[dict[str, str]], dict[str, str]]:
        return typical_answers(self.survey, self.features, self.matrix(), self.levels(), only_affected, labels, selection, extract_const, only_max_level)

    def explain_feature(self, feature: int, side: int = 1) -> list[list[tuple[str, str, Any]]]:
        return explain(self.features[feature], side, {f.name: f for f in self.features})
