"""Scaling of columns and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = df.join(F.broadcast(stats))  # one row
    out = {c: (F.col(c) - F.col(f"m_{i}")) / F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}")) for i, c in enumerate(columns)}
    return both.withColumns(out).select(df.columns)


def balance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x less the column's median."""
    medians = quantiles(df, columns)
    return df.withColumns({c: F.col(c) - F.lit(medians[c]) for c in columns})


def unit_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x over the column's Euclidean length; null for length 0."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(c).cast("double") * F.col(c))).alias(f"n_{i}") for i, c in enumerate(columns)])
    return df.join(F.broadcast(norms)).withColumns({c: F.try_divide(F.col(c), F.col(f"n_{i}")) for i, c in enumerate(columns)}).select(df.columns)  # one row


def _row(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def standardize_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the row; a deviation of 0 counts as 1."""
    # In columns of their own: inside a lambda, Spark takes a name for the new column of that name.
    a, mean, dev = _row(columns), F.col("__mean"), F.col("__dev")
    out = df.withColumn("__mean", _total(a) / len(columns))
    out = out.withColumn("__dev", F.sqrt(_total(F.transform(a, lambda x: (x - mean) * (x - mean))) / len(columns)))
    scaled = {c: (F.col(c) - mean) / F.when(dev == 0, 1.0).otherwise(dev) for c in columns}
    return out.withColumns(scaled).drop("__mean", "__dev")


def balance_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x less the row's median."""
    n = len(columns)
    out = df.withColumn("__row", F.sort_array(_row(columns)))
    median = (F.get("__row", F.lit((n - 1) // 2)) + F.get("__row", F.lit(n // 2))) / 2
    return out.withColumn("__mid", median).withColumns({c: F.col(c) - F.col("__mid") for c in columns}).drop("__row", "__mid")


def unit_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x over the row's Euclidean length; null for length 0."""
    out = df.withColumn("__norm", F.sqrt(_total(F.transform(_row(columns), lambda x: x * x))))
    return out.withColumns({c: F.try_divide(F.col(c), F.col("__norm")) for c in columns}).drop("__norm")
