"""Corners: the row-wise least of two oriented features, as new features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import Feature

#: Orientations of the two features, in the order in which corners are listed.
CORNERS = ((-1, -1), (1, -1), (-1, 1), (1, 1))


def corner(a: Column, oa: int, b: Column, ob: int) -> Column:
    return F.least(a * F.lit(oa), b * F.lit(ob)).cast("tinyint")


def corners(a: Feature, b: Feature) -> list[Feature]:
    """All four corners; what they say refers to both parents."""
    return [
        Feature(f"inf({oa:+d} {a.name}, {ob:+d} {b.name})", corner(a.column, oa, b.column, ob), ("inf", (a.name, oa), (b.name, ob)))
        for oa, ob in CORNERS
    ]


@dataclass
class Identity:
    """Features that equal an earlier one or its negation: ``first`` and ``side`` by position."""

    first: list[int]
    side: list[int]

    def kept(self) -> list[int]:
        return [i for i, f in enumerate(self.first) if f == i]


def column_keys(df: DataFrame, names: Sequence[str], id_col: str = "pid") -> dict[str, tuple]:
    """A key for each column that equal columns share, and its negation has with the other sign.
    Two independent sums of hashes of (row, value), so one pass and one row of results. The
    sums of a column and of its negation together make the key; their order is the sign."""
    aggs = []
    for i, n in enumerate(names):
        for s in (1, -1):
            v = (F.col(n) * F.lit(s)).cast("double") + F.lit(0.0)  # no negative zero
            for seed in (1, 2):
                h = F.xxhash64(F.lit(seed), F.col(id_col), v).cast("decimal(38,0)")
                aggs.append(F.coalesce(F.sum(h), F.lit(0)).alias(f"k{i}_{s}_{seed}"))
    r = df.agg(*aggs).first()
    return {n: ((r[f"k{i}_1_1"], r[f"k{i}_1_2"]), (r[f"k{i}_-1_1"], r[f"k{i}_-1_2"])) for i, n in enumerate(names)}


def identify(df: DataFrame, names: Sequence[str], id_col: str = "pid") -> Identity:
    """Which columns repeat an earlier one, as it is (+1) or negated (-1)."""
    keys, seen, first, side = column_keys(df, names, id_col), {}, [], []
    for i, n in enumerate(names):
        plus, minus = keys[n]
        if plus in seen:
            first.append(seen[plus]), side.append(1)
        elif minus in seen:
            first.append(seen[minus]), side.append(-1)
        else:
            seen[plus] = i
            first.append(i), side.append(1)
    return Identity(first, side)


def lookup(df: DataFrame, known: Sequence[str], wanted: Sequence[str], id_col: str = "pid") -> list[tuple[int, int]]:
    """For each wanted column the position of the known one it equals and its side; (-1, 1)
    where there is none."""
    keys = column_keys(df, [*known, *wanted], id_col)
    at = {keys[n][0]: i for i, n in reversed(list(enumerate(known)))}
    return [(at[keys[n][0]], 1) if keys[n][0] in at else (at[keys[n][1]], -1) if keys[n][1] in at else (-1, 1) for n in wanted]


def all_corners(df: DataFrame, features: Sequence[Feature], others: Sequence[Feature] | None = None, id_col: str = "pid") -> list[Feature]:
    """Distinct corners of all pairs, within one list or between two, in order of appearance."""
    pairs = list(combinations(range(len(features)), 2)) if others is None else [(i, len(features) + j) for i, j in product(range(len(features)), range(len(others)))]
    return _distinct(df, [*features, *(others or [])], pairs, False)


def _distinct(df: DataFrame, base: Sequence[Feature], pairs: Sequence[tuple[int, int]], with_base: bool) -> list[Feature]:
    """Corners of pairs of features (``with_base``: after the features), each once up to negation.
    Corners are functions of the features, so the distinct rows of those tell which are equal."""
    made = [*(base if with_base else []), *[c for i, j in pairs for c in corners(base[i], base[j])]]
    if not made:
        return []
    rows = df.select(*[f.column.alias(f"p{i}") for i, f in enumerate(base)]).distinct()
    on = [Feature(f.name, F.col(f"p{i}")) for i, f in enumerate(base)]
    same = [*(on if with_base else []), *[c for i, j in pairs for c in corners(on[i], on[j])]]
    named = [f"c{i}" for i in range(len(same))]
    table = rows.select(F.struct(*[F.col(f"p{i}") for i in range(len(base))]).alias("row"), *[f.column.alias(n) for f, n in zip(same, named, strict=True)])
    return [made[i] for i in identify(table, named, "row").kept()]


def with_corners(df: DataFrame, features: Sequence[Feature], id_col: str = "pid") -> list[Feature]:
    """Features and the corners of all pairs, each once up to negation."""
    return _distinct(df, features, list(combinations(range(len(features)), 2)), True)


def corner_features(
    df: DataFrame,
    features: Sequence[Feature],
    min_side_size: float = 0,
    is_fraction: bool = False,
    order: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
    max_order_factor: float | None = None,
    global_max_order: float | None = None,
    id_col: str = "pid",
) -> list[Feature]:
    """New corners whose smaller side is large enough and whose order is at most the given
    factor times the larger order of their parents, and at most the global limit."""
    found = with_corners(df, features, id_col)[0:]
    own = {f.name for f in features}
    new = [f for f in found if f.name not in own]
    if not new:
        return []
    parents = {f.name: f"p{i}" for i, f in enumerate(features)}
    named = {f.name: f"c{i}" for i, f in enumerate(new)}
    table = df.select(id_col, *[f.column.alias(parents[f.name]) for f in features], *[f.column.alias(named[f.name]) for f in new])
    sizes = table.agg(F.count("*").alias("n"), *[F.least(F.count_if(F.col(c) > 0), F.count_if(F.col(c) < 0)).alias(c) for c in named.values()]).first()
    least = min_side_size * sizes["n"] if is_fraction else min_side_size
    new = [f for f in new if sizes[named[f.name]] >= least]
    if order is None or not new or (max_order_factor is None and global_max_order is None):
        return new
    columns = [*parents.values(), *[named[f.name] for f in new]]
    value = {columns[r["feature"]]: r["value"] for r in order(table, columns).collect()}
    out = []
    for f in new:
        top = global_max_order if global_max_order is not None else float("inf")
        if max_order_factor is not None:
            top = min(top, max_order_factor * max(value[parents[n]] for n, _ in f.info[1:]))
        if value[named[f.name]] <= top:
            out.append(f)
    return out
