"""Two-sided features from the columns of a table.

A feature is a Column with values -1 and +1 (0: on both sides; or real numbers whose sign is
the side) and what it says: ``(operator, value)`` on a variable. Limits come from one aggregate
over the table; the features themselves are plain expressions that Spark fuses into one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantiles

#: Values of a column that make a feature each, at most.
MOST_VALUES = 10_000
#: A two-valued column is split by its larger or its smaller value, by operator.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}
INVERSE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "in": "not in", "not in": "in"}


@dataclass(frozen=True)
class Feature:
    name: str
    column: Column
    info: Any = None

    def named(self, name: str, info: Any = None) -> Feature:
        return replace(self, name=name, info=self.info if info is None else info)


def side(condition: Column) -> Column:
    """+1 where the condition holds, else -1 (also where it is unknown)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint")


def matrix(df: DataFrame, features: Sequence[Feature], id_col: str = "pid") -> DataFrame:
    """The table of features: ``id_col`` and a column for each."""
    return df.select(id_col, *[f.column.alias(f.name) for f in features])


def from_subset(indicator: Column) -> Column:
    """+1 for positive values, else -1."""
    return side(indicator > 0)


def threshold(col: Column, t: float = 0, small_side_le: bool = True) -> Column:
    """+1 above ``t`` (with ``small_side_le=False`` also at it)."""
    return side(col > t if small_side_le else col >= t)


def distinct_values(df: DataFrame, col: str, invalid: Iterable[Any] = (), most: int = MOST_VALUES) -> list[Any]:
    """Sorted values that are neither null nor invalid. More than ``most`` are an error: a feature
    for each would be a column for each; bins or thresholds are for such a variable."""
    valid = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull())
    if invalid := list(invalid):
        valid = valid.where(~F.col("v").isin(invalid))
    found = valid.distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted(r["v"] for r in found)


def _label(col: str, op: str, value: Any) -> str:
    return f"{col} {op} {value}"


def _feature(col: str, op: str, value: Any) -> Feature:
    return Feature(_label(col, op, value), side(OPERATORS[op](F.col(col), value)), (op, value))


def binary_values(col: str, values: Sequence[Any], op: str = "==") -> list[Feature]:
    """One feature of a column with exactly two values."""
    if len(values) != 2:
        raise ValueError(f"{col}: two values are needed, not {len(values)}")
    return [_feature(col, op, max(values) if op in ("==", "<", ">=") else min(values))]


def one_hot(df: DataFrame, col: str, invalid: Iterable[Any] = (), values: Sequence[Any] | None = None) -> list[Feature]:
    """A feature for each valid value; for two values a single one; for fewer none."""
    values = distinct_values(df, col, invalid) if values is None else list(values)
    if len(values) == 2:
        return binary_values(col, values)
    return [_feature(col, "==", v) for v in values] if len(values) > 2 else []


def ge_splits(df: DataFrame, col: str, invalid: Iterable[Any] = ()) -> list[Feature]:
    """A feature ``>= v`` for each valid value but the smallest."""
    return [_feature(col, ">=", v) for v in distinct_values(df, col, invalid)[1:]]


def _limits(df: DataFrame, col: str, invalid: Iterable[Any]) -> tuple[float, float]:
    valid = df.where(~F.col(col).isin(list(invalid))) if list(invalid) else df
    r = valid.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def regular_ge(df: DataFrame, col: str, num_bins: int = 5, max_extensive: int = 50, invalid: Iterable[Any] = ()) -> list[Feature]:
    """Few values: all splits. Many: thresholds at equal distances between least and greatest.
    Values are only listed if there are at most ``max_extensive``."""
    invalid = list(invalid)
    valid = df.where(~F.col(col).isin(invalid)) if invalid else df
    some = valid.select(F.col(col).alias("v")).where("v IS NOT NULL").distinct().limit(max_extensive + 1).collect()
    values = sorted(r["v"] for r in some)
    if len(values) <= 2:
        return binary_values(col, values, ">=") if len(values) == 2 else []
    if len(values) <= max_extensive:
        return [_feature(col, ">=", v) for v in values[1:]]
    lo, hi = _limits(df, col, invalid)
    return [_feature(col, ">=", lo * (1 - s / num_bins) + hi * (s / num_bins)) for s in range(1, num_bins)]


def regular_bins(df: DataFrame, col: str, num_bins: int = 5, invalid: Iterable[Any] = ()) -> list[Feature]:
    """A feature for each of ``num_bins`` intervals of equal width, the last one closed."""
    lo, hi = _limits(df, col, invalid)
    if lo is None or lo == hi:
        return []
    cuts = [lo * (1 - s / num_bins) + hi * (s / num_bins) for s in range(num_bins + 1)]
    out = []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        last = k == num_bins - 1
        inside = (F.col(col) >= a) & (F.col(col) <= b if last else F.col(col) < b)
        out.append(Feature(f"{col} in [{a}, {b}{']' if last else ')'}", side(inside), ("in", (a, b, True, last))))
    return out


def median_split(df: DataFrame, col: str) -> list[Feature]:
    """+1 above the median."""
    m = quantiles(df, [col])[col]
    return [] if m is None else [_feature(col, ">", m)]


def axis_thresholds(df: DataFrame, cols: Sequence[str], k: int) -> list[Feature]:
    """``k`` cuts at equal distances along each axis; +1 below the cut."""
    limits = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, c in enumerate(cols):
        lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
        out += [_feature(c, "<", lo + (hi - lo) * j / (k + 1)) for j in range(1, k + 1)]
    return out


def invalid_to_both_sides(features: Sequence[Feature], col: str, invalid: Iterable[Any]) -> list[Feature]:
    """0 (both sides) where the variable is invalid or null."""
    bad = F.col(col).isNull() | F.col(col).isin(list(invalid))
    return [replace(f, column=F.when(bad, F.lit(0)).otherwise(f.column).cast("tinyint")) for f in features]


def invalid_feature(col: str, invalid: Iterable[Any]) -> Feature:
    """+1 where the variable is invalid or null."""
    return Feature(f"{col} invalid", side(F.col(col).isNull() | F.col(col).isin(list(invalid))), ("invalid", None))
