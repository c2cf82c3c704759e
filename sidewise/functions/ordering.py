"""Numbers in an order, and exact quantiles, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Parts of a bracket that a pass counts.
PARTS = 1000


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: a row's number from 0 in the order of columns. Rows are dealt by ranges and
    numbered within them; one row for each range meets to tell where it begins."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, since two evaluations could draw the ranges differently.
    ranged = stored(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    base = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    # One row for each range, as many as there are shuffle partitions.
    joined = ranged.withColumn("__own", own).join(F.broadcast(base), "__range")
    return joined.withColumn(out, F.col("__base") + F.col("__own")).drop("__range", "__n", "__base", "__own")


def _number(col: str) -> Column:
    """A column as double; NaN counts as null."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def at_ranks(df: DataFrame, wanted: Sequence[tuple[str, int]]) -> list[float]:
    """The values at given ranks (from 0, among values that aren't null) of columns. Each pass
    counts the parts of a bracket around every wanted rank and keeps the part that holds it, until
    that is a single value: at most ``PARTS`` rows a rank come to the driver."""
    columns = list(dict.fromkeys(c for c, _ in wanted))
    limits = df.agg(*[f(_number(c)).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    at = {c: k for k, c in enumerate(columns)}
    found: dict[int, float] = {}
    bracket = {k: (limits[f"lo{at[c]}"], limits[f"hi{at[c]}"], r) for k, (c, r) in enumerate(wanted)}
    while True:
        for k, (lo, hi, _) in list(bracket.items()):
            if lo == hi:
                found[k] = lo
                del bracket[k]
        if not bracket:
            return [found[k] for k in range(len(wanted))]
        parts = []
        for k, (lo, hi, _) in bracket.items():
            x = _number(wanted[k][0])
            part = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * PARTS), F.lit(PARTS - 1)).cast("int")
            parts.append(F.when(x.between(lo, hi), F.struct(F.lit(k).alias("k"), part.alias("part"), x.alias("x"))))
        each = df.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.*")
        rows = each.groupBy("k", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["k"], r["part"])):
            by.setdefault(r["k"], []).append(r)
        for k, own in by.items():
            rank = bracket[k][2]
            for r in own:
                if rank < r["n"]:
                    if (r["lo"], r["hi"]) == bracket[k][:2]:  # infinite values, which no part divides
                        x = _number(wanted[k][0])
                        value = df.select(x.alias("x")).where(x.between(r["lo"], r["hi"])).orderBy("x").offset(rank).limit(1).first()["x"]
                        bracket[k] = (value, value, 0)
                    else:
                        bracket[k] = (r["lo"], r["hi"], rank)
                    break
                rank -= r["n"]


def quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact quantiles, interpolated between neighbours; None for columns without a value."""
    sizes = df.agg(*[F.count(_number(c)).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    wanted, places = [], {}
    for k, c in enumerate(columns):
        if sizes[f"n{k}"]:
            place = q * (sizes[f"n{k}"] - 1)
            low = int(place)
            places[c] = (len(wanted), place - low)
            wanted += [(c, low), (c, min(low + 1, sizes[f"n{k}"] - 1))]
    values = at_ranks(df, wanted) if wanted else []
    return {c: values[places[c][0]] + (values[places[c][0] + 1] - values[places[c][0]]) * places[c][1] if c in places else None for c in columns}
