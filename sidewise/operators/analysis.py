"""What accords say about rows and about each other.

Accord matrices (rows of -1/0/+1 by level) are small and stay on the driver; scores and
clusters of rows are expressions over the table of features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accord_scores(
    df: DataFrame, names: Sequence[str], accords: DataFrame, normalize_rows: bool = True, normalize_cols: bool = False, id_col: str = "pid"
) -> DataFrame:
    """``pid, accord, score``: features times chosen sides, added up. Rows, then accords, are
    moved to a least score of 0 and divided by their sum unless that is 0. ``accords``: table
    ``accord, feature, side``, of a size the driver's tree bounds."""
    by_accord: dict[int, list[tuple[int, int]]] = {}
    for r in accords.select("accord", "feature", "side").collect():
        if not 0 <= r["feature"] < len(names):
            raise ValueError(f"accords refer to feature {r['feature']}; there are {len(names)}")
        by_accord.setdefault(r["accord"], []).append((r["feature"], r["side"]))
    if not by_accord:
        return df.select(id_col, F.lit(0).alias("accord"), F.lit(0.0).alias("score")).limit(0)
    accord = sorted(by_accord)
    scores = [sum((F.col(names[f]) * s for f, s in by_accord[a]), F.lit(0)).cast("double").alias(f"s{k}") for k, a in enumerate(accord)]
    # All scores of a row stand in its columns, so rows are normalised where they are.
    out, own = df.select(id_col, *scores), [F.col(f"s{k}") for k in range(len(accord))]
    if normalize_rows:
        low = F.least(*own) if len(own) > 1 else own[0]
        out = out.withColumn("low", low).withColumn("total", sum(own, F.lit(0.0)) - len(own) * F.col("low"))
        own = [(x - F.col("low")) / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0) for x in own]
    number = F.get(F.array(*[F.lit(a) for a in accord]), F.col("k"))
    out = out.select(id_col, F.posexplode(F.array(*own)).alias("k", "score")).select(id_col, number.alias("accord"), "score")
    if normalize_cols:
        stats = out.groupBy("accord").agg(F.min("score").alias("lo"), (F.sum("score") - F.count("*") * F.min("score")).alias("t"))
        # One row for each accord.
        out = out.join(F.broadcast(stats), "accord")
        score = (F.col("score") - F.col("lo")) / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)
        out = out.select(id_col, "accord", score.alias("score"))
    return out


def subtrees(matrix: np.ndarray) -> tuple[int | None, list[np.ndarray]]:
    """The first column in which accords disagree with the longest one, and which accords have
    either sign there; (None, [all]) if none does."""
    if len(matrix) <= 1:
        return None, [np.ones(len(matrix), bool)]
    longest = matrix[np.argmax((matrix != 0).sum(axis=1))]
    for k in range(matrix.shape[1]):
        if longest[k] and (matrix[:, k] == -longest[k]).any():
            return k, [matrix[:, k] == longest[k], matrix[:, k] == -longest[k]]
    return None, [np.ones(len(matrix), bool)]


def _splits(matrix: np.ndarray, rows: np.ndarray, path: list[tuple[int, int, list[tuple[int, int]]]], out: dict) -> None:
    """For each accord its splits: column, sign, and the columns that go along with it."""
    k, parts = subtrees(matrix[rows])
    if k is None:
        for r in rows:
            out[int(r)] = path
        return
    here = matrix[rows]
    ends = rows[here[:, k] == 0]
    for r in ends:
        out[int(r)] = path
    along = []
    for c in range(k, matrix.shape[1]):
        same = [set(here[p, c].tolist()) for p in parts]
        if all(len(x) == 1 for x in same) and same[0] == {-v for v in same[1]} and 0 not in same[0]:
            along.append((c, int(here[parts[0]][0, c])))
    first = int(here[parts[0]][0, k])
    for part, sign in zip(parts, (1, -1), strict=True):
        sides = [(c, s * sign) for c, s in along]
        _splits(matrix, rows[part], [*path, (k, first * sign, sides)], out)


def hard_clusters(matrix: np.ndarray, names: Sequence[str]) -> list[Column]:
    """For each accord 1 for rows that are on its side at every split, else 0. A row on both sides
    of a split (0) counts as on the negative one."""
    out: dict[int, list] = {}
    _splits(matrix, np.arange(len(matrix)), [], out)
    columns = []
    for k in range(len(matrix)):
        inside = F.lit(True)
        for c, s, _ in out[k]:
            inside = inside & (F.col(names[c]) > 0 if s > 0 else F.col(names[c]) <= 0)
        columns.append(inside.cast("double").alias(f"accord_{k}"))
    return columns


def soft_clusters(matrix: np.ndarray, names: Sequence[str]) -> list[Column]:
    """For each accord the product over its splits of the share of columns that all accords of
    either part decide oppositely, and that agree with the row; a row on both sides of a column
    (0) agrees by half."""
    out: dict[int, list] = {}
    _splits(matrix, np.arange(len(matrix)), [], out)
    columns = []
    for k in range(len(matrix)):
        p = F.lit(1.0)
        for _, _, sides in out[k]:
            p = p * (sum(((F.col(names[c]) * s + 1) / 2 for c, s in sides), F.lit(0.0)) / len(sides))
        columns.append(p.alias(f"accord_{k}"))
    return columns


def coherence_levels(matrix: np.ndarray) -> np.ndarray:
    """The first level at which an accord has no side; -1 if it has all."""
    zero = matrix == 0
    return np.where(zero.any(axis=1), zero.argmax(axis=1), -1)


def complexity_levels(matrix: np.ndarray) -> np.ndarray:
    """The level by which an accord differs from every other one that doesn't go along with it."""
    out = np.zeros(len(matrix), int)
    for i, own in enumerate(matrix):
        worst = 0
        for j, other in enumerate(matrix):
            if i != j:
                differ = np.flatnonzero(own * other == -1)
                if len(differ):
                    worst = max(worst, int(differ[0]))
                else:
                    longer = np.flatnonzero(own != other)
                    worst = max(worst, int(longer[0]) if len(longer) else 0)
        out[i] = worst
    return out


def visibility(matrix: np.ndarray, orders: np.ndarray, coherence: np.ndarray | None = None, complexity: np.ndarray | None = None) -> np.ndarray:
    """How long an accord is seen: the order where it ends less that where it stands apart."""
    coherence = coherence_levels(matrix) if coherence is None else coherence
    complexity = complexity_levels(matrix) if complexity is None else complexity
    ends = np.where(coherence < 0, len(orders) - 1, coherence)
    return np.asarray(orders)[ends] - np.asarray(orders)[complexity]


def without_prefixes(matrix: np.ndarray) -> np.ndarray:
    """Accords whose sides a longer one repeats are left out, as are repeated rows."""
    keep = []
    for i, own in enumerate(matrix):
        on = own != 0
        longer = any(
            i != j and (other[on] == own[on]).all() and ((other != 0).sum() > on.sum() or j < i) for j, other in enumerate(matrix)
        )
        keep.append(not longer)
    return matrix[np.array(keep, bool)] if len(matrix) else matrix


def location_size(df: DataFrame, oriented: Sequence[tuple[str, int]]) -> int:
    """Rows on all sides of a star."""
    from .counts import infimum

    return df.where(infimum(oriented) == 1).count()


def softmax_mean(df: DataFrame, score: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` weighted by exp(score)."""
    w = F.exp(score)
    return df.groupBy(*group).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))


def keyed_standardize(df: DataFrame, columns: Sequence[str], reverse: Sequence[str] = ()) -> DataFrame:
    """Standardised answers, those of reversed items negated."""
    from ..functions.scaling import standardize

    return standardize(df, columns).withColumns({c: -F.col(c) for c in reverse})
