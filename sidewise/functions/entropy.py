"""Entropies of columns in nats. Values are counted with partial sums before each shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of_counts(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """ln N - sum(n ln n) / N; 0 for an empty table."""
    value = F.log(F.sum(n)) - F.sum(F.col(n) * F.log(n)) / F.sum(n)
    return counts.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("value"))


def entropies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``col, value``: the entropy of each column; null counts as a value."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(each).alias("s")).groupBy("s.col", "s.v").agg(F.count("*").alias("n"))
    return _of_counts(counts, ["col"])


def joint_entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``value``: the entropy of the rows' tuples."""
    return _of_counts(df.groupBy(*columns).agg(F.count("*").alias("n")), [])


def pair_entropies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a, b, value``: joint entropies of many pairs by one aggregation."""
    each = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
        for a, b in pairs
    ])
    counts = df.select(F.explode(each).alias("s")).groupBy("s.a", "s.b", "s.x", "s.y").agg(F.count("*").alias("n"))
    return _of_counts(counts, ["a", "b"])


def pairwise_mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, value`` for a before b: H(a) + H(b) - H(a, b). The diagonal is 0 by definition."""
    return gains(df, list(combinations(columns, 2)))


def gains(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a, b, value``: H(a) + H(b) - H(a, b) of given pairs."""
    single = entropies(df, list(dict.fromkeys(x for p in pairs for x in p)))
    left, right = single.toDF("a", "ha"), single.toDF("b", "hb")
    joined = pair_entropies(df, pairs).join(F.broadcast(left), "a").join(F.broadcast(right), "b")  # a row for each column
    return joined.select("a", "b", (F.col("ha") + F.col("hb") - F.col("value")).alias("value"))


def information_gain(df: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``feature, value``: H(f) + H(X) - H(X, f) for the tuple X of columns."""
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    with_x = df.withColumn("__x", whole)
    return gains(with_x, [(f, "__x") for f in features]).select(F.col("a").alias("feature"), "value")


def pointwise_gains(df: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``a`` (column), ``b`` (feature), ``value``."""
    return gains(df, [(c, f) for c in columns for f in features])


def split_information(df: DataFrame, parts: Sequence[tuple[Sequence[str], Sequence[str]]], joint: bool = True) -> list[float]:
    """For splits of columns in two: H(left) + H(right) - H(both), or with ``joint=False`` the
    smaller of the two."""
    out = []
    for left, right in parts:
        l, r = (joint_entropy(df, x).first()["value"] if len(x) else 0.0 for x in (left, right))
        out.append(l + r - joint_entropy(df, [*left, *right]).first()["value"] if joint else min(l, r))
    return out
