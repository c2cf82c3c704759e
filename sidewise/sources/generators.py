"""Generated features and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_features(spark: SparkSession, k: int, n: int, p: float = 0.5, seed: int = 0) -> DataFrame:
    """``pid`` and ``k`` independent features that are +1 with probability ``p``; a row's values
    depend on its id and the seed alone."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("pid")), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(n).select(F.col("id").alias("pid")).select(
        "pid", *[F.when(draw(i) < p, 1).otherwise(-1).cast("tinyint").alias(f"f{i}") for i in range(k)]
    )


def grid_graph(spark: SparkSession, shape: tuple[int, int], max_dist: float, normalize: bool = False, metric: str = "euclidean") -> DataFrame:
    """Edges ``src, dst, w`` between cells of a grid (numbered by rows) at a distance in
    (0, max_dist]; the weight is the distance, divided by ``max_dist`` if ``normalize``."""
    rows, cols = shape
    reach = int(max_dist)
    offsets: list[tuple[int, int, float]] = []
    for r in range(-reach, reach + 1):
        for c in range(-reach, reach + 1):
            d = (r * r + c * c) ** 0.5 if metric == "euclidean" else abs(r) + abs(c)
            if 0 < d <= max_dist:
                offsets.append((r, c, d / max_dist if normalize else float(d)))
    each = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(d).alias("w")) for r, c, d in offsets])
    cells = spark.range(rows * cols).select("id", F.expr(f"id div {cols}").alias("r"), F.expr(f"id % {cols}").alias("c"))
    near = cells.select("id", "r", "c", F.explode(each).alias("o")).select(
        F.col("id").alias("src"), (F.col("r") + F.col("o.r")).alias("r2"), (F.col("c") + F.col("o.c")).alias("c2"), "o.w"
    )
    inside = (F.col("r2").between(0, rows - 1)) & (F.col("c2").between(0, cols - 1))
    return near.where(inside).select("src", (F.col("r2") * cols + F.col("c2")).alias("dst"), "w")


def from_matrix(spark: SparkSession, values: Sequence[Sequence[float]], names: Sequence[str] | None = None) -> DataFrame:
    """A driver-side matrix as a table with ``pid``."""
    names = list(names or [f"f{i}" for i in range(len(values[0]) if len(values) else 0)])
    return spark.createDataFrame([(k, *row) for k, row in enumerate(values)], ["pid", *names])


def from_sparse(entries: DataFrame, names: Sequence[str], points: DataFrame, id_col: str = "pid") -> DataFrame:
    """Features from the entries ``pid, col`` that are +1; all others are -1."""
    wide = entries.groupBy(id_col).agg(*[F.max(F.when(F.col("col") == i, 1)).alias(n) for i, n in enumerate(names)])
    joined = points.select(id_col).join(wide, id_col, "left")
    return joined.select(id_col, *[F.coalesce(F.col(n), F.lit(-1)).cast("tinyint").alias(n) for n in names])


def encoding(df: DataFrame, names: Sequence[str]) -> str:
    """"feature" for two values or fewer, "set" for -1/0/+1, else "real"."""
    # Four values at most come to the driver.
    values = {r["v"] for r in df.select(F.explode(F.array_distinct(F.array(*[F.col(n).cast("double") for n in names]))).alias("v")).distinct().limit(4).collect()}
    if len(values) == 3 and min(values) < 0 < max(values) and 0 in values:
        return "set"
    return "feature" if len(values) <= 2 else "real"
