"""Counts over the rows of a table of features.

Everything reduces to rows with equal values, the atoms, with how many there are: one
aggregation with partial counts before the only large shuffle. Counts of pairs and triples are
then taken over atoms. Values: -1 and +1; 0 is on both sides; sides with strict signs exclude it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered

Oriented = tuple[str, int]


def atoms(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct rows of features with their number ``w``."""
    return df.groupBy(*names).agg(F.count("*").alias("w"))


def atomic_sets(df: DataFrame, names: Sequence[str], id_col: str = "pid") -> DataFrame:
    """Distinct rows with ``w``, their least id and a dense number in the order of values."""
    return numbered(df.groupBy(*names).agg(F.count("*").alias("w"), F.min(id_col).alias("first_pid")), names, "aid")


def unique_rows(df: DataFrame, names: Sequence[str], id_col: str = "pid") -> DataFrame:
    """Distinct rows with their number, the id of the first and, in its order, a number of their
    own: ``membership`` gives the inverse."""
    return numbered(df.groupBy(*names).agg(F.count("*").alias("n"), F.min(id_col).alias("first_pid")), ["first_pid"], "aid")


def membership(df: DataFrame, numbered: DataFrame, names: Sequence[str], id_col: str = "pid") -> DataFrame:
    """``id_col, aid``: the atom of each row."""
    same = reduce(Column.__and__, [F.col(f"d.{n}").eqNullSafe(F.col(f"a.{n}")) for n in names])
    return df.alias("d").join(numbered.alias("a"), same).select(f"d.{id_col}", "a.aid")


def to_atomic(rows: DataFrame, member: DataFrame, names: Sequence[str], id_col: str = "pid") -> DataFrame:
    """Features on atoms: +1 if all rows of the atom are positive, else -1."""
    each = [F.when(F.min(n) > 0, 1).otherwise(-1).cast("tinyint").alias(n) for n in names]
    return rows.join(member, id_col).groupBy("aid").agg(*each)


def from_atomic(on_atoms: DataFrame, member: DataFrame, id_col: str = "pid") -> DataFrame:
    """Features of atoms back on their rows."""
    return member.join(on_atoms, "aid").drop("aid")


def side_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature, positive, ge_zero, le_zero``; 0 counts on both sides."""
    stats = [
        F.struct(
            F.lit(n).alias("feature"),
            F.count_if(F.col(n) > 0).alias("positive"),
            F.count_if(F.col(n) >= 0).alias("ge_zero"),
            F.count_if(F.col(n) <= 0).alias("le_zero"),
        ).alias(f"s{i}")
        for i, n in enumerate(names)
    ]
    one = df.agg(*stats)
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


def infimum(oriented: Sequence[Oriented]) -> Column:
    """Row-wise least of the oriented values."""
    values = [F.col(n) * F.lit(o) for n, o in oriented]
    return values[0] if len(values) == 1 else F.least(*values)


def agreement(df: DataFrame, oriented: Sequence[Oriented], weight: str | None = None) -> Column:
    """Aggregate: rows strictly on all chosen sides. Equals the rows outside all small sides."""
    inside = reduce(Column.__and__, [F.col(n) * F.lit(o) > 0 for n, o in oriented])
    return F.count_if(inside) if weight is None else F.coalesce(F.sum(F.when(inside, F.col(weight))), F.lit(0))


def real_agreement(oriented: Sequence[Oriented]) -> Column:
    """Aggregate for real features: where all oriented values are positive, their total."""
    values = [F.col(n) * F.lit(float(o)) for n, o in oriented]
    least = values[0] if len(values) == 1 else F.least(*values)
    return F.coalesce(F.sum(F.when(least > 0, reduce(Column.__add__, values))), F.lit(0.0))


def _sides(names: Sequence[str]) -> Column:
    """The oriented sides of a row as numbers 2 * feature + (1 if positive), ascending."""
    each = [F.when(F.col(n) > 0, 2 * i + 1).when(F.col(n) < 0, 2 * i) for i, n in enumerate(names)]
    return F.array_compact(F.array(*each))


def tuple_counts(df: DataFrame, names: Sequence[str], size: int = 3) -> DataFrame:
    """``s1 <= s2 <= s3, n``: rows on all of up to three oriented sides (numbered as in
    ``_sides``); repeats make pairs and single sides. Tuples that no row has are absent."""
    rows = atoms(df, names).select(_sides(names).alias("s"), "w")
    at = lambda i: F.get("s", i)
    tuples = rows.select("s", "w", F.posexplode("s").alias("i", "s1"))
    span = lambda lo: F.sequence(F.col(lo), F.size("s") - 1)
    keys = ["s1"]
    if size > 1:
        tuples = tuples.withColumn("j", F.explode(span("i"))).withColumn("s2", at(F.col("j")))
        keys.append("s2")
    if size > 2:
        tuples = tuples.withColumn("k", F.explode(span("j"))).withColumn("s3", at(F.col("k")))
        keys.append("s3")
    return tuples.groupBy(*keys).agg(F.sum("w").alias("n"))


def pair_contingency(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``i < j, a, b, n``: rows by the signs of each pair of features, from one scan."""
    rows = atoms(df, names).select(
        F.array(*[F.signum(F.col(n).cast("double")).cast("int") for n in names]).alias("v"), "w"
    )
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(len(names)), 2)])
    each = rows.select("v", "w", F.explode(pairs).alias("p")).select(
        "p.i", "p.j", F.get("v", F.col("p.i")).alias("a"), F.get("v", F.col("p.j")).alias("b"), "w"
    )
    return each.groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n"))


def comparable(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``i, j, oi, oj, le``: whether oriented side (i, oi) lies below (j, oj): its rows at >= 0
    are there too, and the other's rows at <= 0 are here too."""
    table = pair_contingency(df, names)
    grid = F.array(*[F.struct(F.lit(x).alias("oi"), F.lit(y).alias("oj")) for x in (-1, 1) for y in (-1, 1)])
    both = table.select("i", "j", "a", "b", "n").union(table.select(F.col("j"), F.col("i"), F.col("b"), F.col("a"), "n"))
    each = both.select("*", F.explode(grid).alias("o")).select("i", "j", "o.oi", "o.oj", (F.col("a") * F.col("o.oi")).alias("x"), (F.col("b") * F.col("o.oj")).alias("y"), "n")
    against = ((F.col("x") >= 0) & (F.col("y") < 0)) | ((F.col("y") <= 0) & (F.col("x") > 0))
    return each.groupBy("i", "j", "oi", "oj").agg((F.coalesce(F.sum(F.when(against, F.col("n"))), F.lit(0)) == 0).alias("le"))


def comparable_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``comparable`` for real features: the values of (i, oi) are nowhere above those of (j, oj).
    The least and greatest sum and difference of each pair tell for all four orientations."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(b) - F.col(a)).alias("d"), (F.col(a) + F.col(b)).alias("s"))
        for (i, a), (j, b) in combinations(enumerate(names), 2)
    ])
    ends = df.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j").agg(
        F.min("p.d").alias("d0"), F.max("p.d").alias("d1"), F.min("p.s").alias("s0"), F.max("p.s").alias("s1")
    )
    up, down, under, over = F.col("d0") >= 0, F.col("d1") <= 0, F.col("s1") <= 0, F.col("s0") >= 0
    # (first side, second side): whether first <= second, and second <= first.
    rules = {(1, 1): (up, down), (-1, -1): (down, up), (1, -1): (under, over), (-1, 1): (over, under)}
    each = [
        F.struct(F.col(x).alias("i"), F.col(y).alias("j"), F.lit(p).alias("oi"), F.lit(q).alias("oj"), le.alias("le"))
        for (a, b), (one, two) in rules.items()
        for x, y, p, q, le in (("i", "j", a, b, one), ("j", "i", b, a, two))
    ]
    return ends.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def crossing_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``i < j`` of features of which no orientations are comparable."""
    return comparable(df, names).where("i < j").groupBy("i", "j").agg(F.max("le").alias("nested")).where(~F.col("nested")).select("i", "j")


def first_crossing(df: DataFrame, names: Sequence[str]) -> tuple[int, int] | tuple[None, None]:
    r = crossing_pairs(df, names).agg(F.min(F.struct("i", "j")).alias("p")).first()["p"]
    return (None, None) if r is None else (r["i"], r["j"])


class Counter:
    """Counts of rows on any sets of oriented sides, asked for in batches.

    The atoms are kept; each batch of new sets is one pass over them in which every partition
    adds up its own counts, so what moves is one number for each set and partition. Answers are
    remembered."""

    def __init__(self, df: DataFrame, names: Sequence[str], real: bool = False) -> None:
        self.names, self.real = list(names), real
        self.rows = (df.select(*names).withColumn("w", F.lit(1)) if real else atoms(df, names)).cache()
        self.known: dict[frozenset[tuple[int, int]], float] = {}
        # Kept for the life of the counter; ``close`` gives it up.
        self.total = int(self.rows.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first()["n"])
        self.known[frozenset()] = self.total
        if not real and len(self.names) <= 12:
            self._prime(df)

    def close(self) -> None:
        self.rows.unpersist()

    def _prime(self, df: DataFrame) -> None:
        """Few features: all triples by one aggregation."""
        sides = [(i, o) for i in range(len(self.names)) for o in (-1, 1)]
        for size in (1, 2, 3):
            self.known.update({frozenset(c): 0 for c in combinations(sides, size)})
        for r in tuple_counts(df, self.names).collect():
            self.known[frozenset((s // 2, 1 if s % 2 else -1) for s in (r["s1"], r["s2"], r["s3"]))] = r["n"]

    def many(self, sets: Sequence[frozenset[tuple[int, int]]]) -> None:
        """Count all sets that aren't known yet."""
        new = list(dict.fromkeys(s for s in sets if s not in self.known))
        for at in range(0, len(new), 50_000):
            self._count(new[at : at + 50_000])

    def _count(self, new: list[frozenset[tuple[int, int]]]) -> None:
        asked, real, n = [sorted(s) for s in new], self.real, len(self.names)

        def run(batches):  # noqa: ANN001, ANN202
            totals = np.zeros(len(asked), np.float64 if real else np.int64)
            for batch in batches:
                v = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))
                w = batch.column(n).to_numpy()
                if real:
                    for k, s in enumerate(asked):
                        x = np.stack([o * v[:, i] for i, o in s], axis=1)
                        totals[k] += x[x.min(axis=1) > 0].sum()
                else:
                    on = {(i, o): v[:, i] * o > 0 for s in asked for i, o in s}
                    for k, s in enumerate(asked):
                        totals[k] += w[reduce(np.logical_and, [on[x] for x in s])].sum()
            found = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found].astype(np.float64))], names=["k", "n"])

        got = self.rows.mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
        self.known.update({s: 0 for s in new})
        self.known.update({new[r["k"]]: r["n"] if real else round(r["n"]) for r in got})

    def __call__(self, *oriented: tuple[int, int]) -> float:
        key = frozenset(oriented)
        if key not in self.known:
            self.many([key])
        return self.known[key]
