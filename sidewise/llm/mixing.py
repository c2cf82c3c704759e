"""Mixing of sources to target weights by subset sums over document lengths (operator 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20240607
#: Rows of a range of the seeded hash, by which (source, length) groups are split, and the
#: number of ranges at least.
SPAN_ROWS, SPANS = 100_000, 1024
#: The sum that is left to the knapsack at first, and at most: four bytes each.
LIMIT, MOST_SUM = 1 << 18, 1 << 26


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight. A source stops at ``most`` times its size
    and the excess is shared again by weight, until none is above: the sources in order of
    size to weight stop one after another, and the rest has one price."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    top, left, out = most * size, share * size.sum(), np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        want = left * w / w[open_].sum()
        over = open_ & (want > top)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = top[over]
        left -= top[over].sum()
        open_ &= ~over
    return out.tolist()


def subset(length: np.ndarray, count: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """Documents of each length whose sum is nearest to ``budget``, and that sum: a bounded
    knapsack over all lengths. Counts go by powers of two. For each sum only the step that first
    reaches it is kept, so going back from the best sum uses each step once."""
    out = np.zeros(len(length), np.int64)
    usable = np.flatnonzero((count > 0) & (length > 0) & (length <= 2 * max(budget, 1)))
    top = budget + int(length[usable].max(initial=0)) + 1
    step, steps = np.full(top, -1, np.int32), []
    step[0] = 0
    for i in usable:
        n, k = min(int(count[i]), budget // int(length[i]) + 1), 1
        while n > 0 and step[budget] < 0:
            k = min(k, n)
            n -= k
            w = k * int(length[i])
            if w < top:
                steps.append((i, k))
                new = np.flatnonzero((step[:-w] >= 0) & (step[w:] < 0)) + w
                step[new] = len(steps)
            k *= 2
        if step[budget] >= 0:
            break
    reached = np.flatnonzero(step >= 0)
    best = int(reached[np.argmin(np.abs(reached - budget))])
    at = best
    while at:
        i, k = steps[step[at] - 1]
        out[i] += k
        at -= k * int(length[i])
    return out, best


def choose(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that the sum is nearest to ``budget``.

    The same fraction of each length first, then the longest while more than ``LIMIT`` is left;
    the rest is a bounded knapsack over all lengths. If the sum is as near as the lengths' common
    divisor allows, nothing is nearer. Else more and more of the budget goes to the knapsack, in
    the end all of it, up to sums of ``MOST_SUM``; beyond that the nearest sum found stands."""
    length, count = np.asarray(length, np.int64), np.asarray(count, np.int64)
    total = int((length * count).sum())
    budget = max(0, min(int(budget), total))
    divisor = int(np.gcd.reduce(length)) or 1
    off = min(budget % divisor, -budget % divisor)
    found, gap = np.zeros(len(length), np.int64), None
    limit = LIMIT
    while True:
        base = np.zeros(len(length), np.int64)
        if total and limit < budget:
            base = np.minimum(count, (count.astype(object) * budget // total).astype(np.int64))
        rest = budget - int((length * base).sum())
        for i in np.argsort(-length, kind="stable"):
            if rest <= limit or not length[i]:
                break
            k = min(int(count[i] - base[i]), (rest - limit) // int(length[i]) + 1, rest // int(length[i]))
            base[i] += k
            rest -= k * int(length[i])
        more, reached = subset(length, count - base, rest)
        if gap is None or abs(reached - rest) < gap:
            found, gap = base + more, abs(reached - rest)
        if gap <= off or limit >= budget or limit >= MOST_SUM:
            return found
        limit *= 16


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's length counts: copies that every document gets, and how many documents of
    each length get one more."""
    source_size = int(pdf["source_size"].iloc[0])
    target = float(pdf["target"].iloc[0])
    every = int(target // source_size) if source_size else 0
    extra = choose(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target) - every * source_size)
    return pdf[["source", "size", "source_size", "target"]].assign(every=every, extra=extra)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` (0, 1 or 2) is how often the mix takes the document and ``taken`` the words of
    that. A source's taken words come as near its target as ``choose`` says. Which documents of a
    length are taken is settled by a seeded hash of id and text, so reruns agree. Null and empty
    texts have size 0 and add nothing; very long ones count whole. A null source is one source,
    the last. Rows with one id, null too, are documents of their own; equal rows share their
    place in the seeded order. Other columns are ignored, whatever their names; an empty table gives an
    empty one. The driver sees one row for each source; a source's task sees one count for each
    document length, not the documents.

    A (source, length) group is split by ranges of the seeded hash, as many as keep each near
    ``SPAN_ROWS`` rows.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(text_col).alias("size"), place.alias("order"),
        ),
        "sizes",
    )
    n_spans = max(SPANS, sized.count() // SPAN_ROWS)
    spans = sized.withColumn("span", F.expr(f"order div {(1 << 40) // n_spans}").cast("int"))
    # Counts by (source, size, span) say how many come before a span in the seeded order.
    counts = spans.groupBy("source", "size", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("span")
    counts = counts.withColumn("before", F.sum("n").over(before) - F.col("n"))
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    # Python orders strings by code point.
    sources = sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = spark.createDataFrame(
        [(r["source"], r["source_size"], t) for r, t in zip(sources, targets([r["source_size"] for r in sources]), strict=True)],
        "source string, source_size long, target double",
    )
    lengths = lengths.alias("l").join(goal.alias("g"), F.expr("l.source <=> g.source")).select("l.*", "source_size", "target")
    fitted = lengths.groupBy("source").applyInPandas(
        _fit, "source string, size long, source_size long, target double, every int, extra long"
    )
    plan = counts.alias("c").join(
        fitted.alias("f"), F.expr("c.source <=> f.source AND c.size = f.size")
    ).select("c.source", "c.size", "c.span", "before", "n", "source_size", "target", "every", "extra")
    within = Window.partitionBy("source", "size", "span").orderBy("order", "doc_id")
    ranked = spans.withColumn("rank", F.row_number().over(within))
    joined = ranked.alias("r").join(
        plan.alias("p"), F.expr("r.source <=> p.source AND r.size = p.size AND r.span = p.span")
    )
    more = (F.col("before") + F.col("rank") <= F.col("extra")).cast("int")
    return joined.select(
        "doc_id", "r.source", "r.size", "source_size", "target", (F.col("every") + more).alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
