"""Exact top-k inner products by norm-bucketed retrieval (operator 8).

Vectors are grouped by length: a bucket holds those whose norms lie within a factor of
2^(1/8), in blocks of a fixed size. Blocks of the longest vectors are searched first and give each
query a floor. By it a query's local cosine threshold for a block is known: above 1 the block
can't hold a result, and pairs of blocks for which that is so for all queries are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table

K = 5
SCALE = 256
#: Queries and candidates of a block.
QUERY_ROWS, BLOCK_ROWS = 1024, 4096
#: Queries whose products are made together; those of like thresholds stand together.
TOGETHER = 64
#: From this local cosine on, a query's largest coordinates prune before products are made.
COORDINATE_COSINE = 0.7
FOCUS = 16
#: Products below this are exact in floating point.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Blocks of a bucket that meet queries in one group of pairs.
SPREAD = 64


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, v array<long>, norm``; rows with a null vector, or one that holds null, NaN
    or infinity, are left out. ``row`` is a row's own number. Components beyond 64 bits become
    the nearest 64-bit integer. Other columns are ignored, whatever their names."""
    bounded_batches(df.sparkSession)
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(1 << 63)

    def whole(x: Column) -> Column:
        y = F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most * (1 - 2**-53))))
        return y.cast("long")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))
    # Written, so that a row has one number wherever it is used.
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "vectors")
    return out.select("row", "vec_id", "v", norm.alias("norm"))


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as they need."""
    top = np.abs(x.astype(np.float64)).max(initial=0)
    for kind in (np.int16, np.int32):
        if top <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _bucket(norm: float) -> int:
    return int(np.floor(np.log2(norm) * 8)) if norm > 0 else -(1 << 20)


def _pack(size: int, by_norm: bool):
    """Rows of one width, and of one bucket of norms where asked for, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, int, np.ndarray, float]]] = {}

        def block(key: tuple[int, int], rows: list) -> pa.RecordBatch:
            vectors = _smallest(np.array([r[2] for r in rows], np.int64).reshape(len(rows), key[0]))
            columns = [
                pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                pa.array([max(r[3] for r in rows)]), pa.array([len(rows)], pa.int32()), pa.array([vectors.itemsize], pa.int32()),
                pa.array([np.array([r[0] for r in rows], np.int64).tobytes()]),
                pa.array([np.array([r[1] for r in rows], np.int64).tobytes()]),
                pa.array([vectors.tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=_PACKED_NAMES)

        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            some = (batch.column(c).to_pylist() for c in ("row", "vec_id", "norm"))
            for row, i, norm, a, b in zip(*some, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                key = (b - a, _bucket(norm) if by_norm else 0)
                rows = held.setdefault(key, [])
                rows.append((row, MOST if i is None else i, flat[a:b], norm))
                if len(rows) == size:
                    yield block(key, rows)
                    del held[key]
        for key, rows in held.items():
            yield block(key, rows)

    return run


_PACKED = "width int, bucket int, top double, n int, item int, rows binary, ids binary, vectors binary"
_PACKED_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


class _Block:
    def __init__(self, row: dict, side: str) -> None:
        self.rows, self.ids = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("rows", "ids"))
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[row[f"{side}_item"]]
        self.vectors = np.frombuffer(row[f"{side}_vectors"], kind).reshape(len(self.ids), row["width"])


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: by floating point where that is exact, by 64-bit
    integers, or else by integers of any size."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < float(1 << 62):
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.array([[sum(map(int.__mul__, a, b)) for b in c.tolist()] for a in q.tolist()], object).reshape(len(q), len(c))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def search(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple:
    """The ``k`` best of a block of candidates for each query, as far as they can reach ``floor``
    (a score that ``k`` candidates elsewhere are known to have; ties count): numbers of queries
    and candidates, and scores.

    Candidates stand by falling norm, so a query's length bound leaves a first part of them.
    Queries with like parts go together, and only those parts are multiplied. Where a query's
    local cosine threshold is high, its own largest coordinates and the norms of the rest bound
    each product first, and only what is left is verified. A query's own row is left out."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(q) or not len(c):
        return none
    qn, cn, slack = _norms(q), _norms(c), 1 + 1e-9
    order = np.argsort(-cn, kind="stable")
    c, c_rows, c_ids, cn = c[order], c_rows[order], c_ids[order], cn[order]
    # Number of candidates that the length bound leaves.
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(qn > 0, floor / (qn * slack), np.where(floor > 0, np.inf, -np.inf))
    part = np.searchsorted(-cn, -least, side="right")
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((qn > 0) & (cn[0] > 0), floor / (qn * cn[0]), -np.inf)
    big = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(c.astype(np.float64)).max(initial=0) * max(1, q.shape[1]) >= EXACT
    coordinate = (local >= COORDINATE_COSINE) & (part > 0) & (c.shape[1] > FOCUS) & (not big)
    rows, cols, scores = [], [], []

    def keep(i: int, at: np.ndarray, values: np.ndarray) -> None:
        fine = (c_rows[at] != q_rows[i]) & (values >= floor[i])
        at, values = at[fine], values[fine]
        if len(at) > k:
            best = np.partition(values, len(at) - k)[len(at) - k] if values.dtype != object else sorted(values)[len(at) - k]
            near = np.flatnonzero(values >= best)
            at, values = at[near], values[near]
            near = np.lexsort((c_ids[at], -values))[:k] if values.dtype != object else sorted(range(len(at)), key=lambda x: (-values[x], c_ids[at[x]]))[:k]
            at, values = at[near], values[near]
        rows.append(np.full(len(at), i))
        cols.append(at)
        scores.append(values)

    if coordinate.any():
        by_place = np.ascontiguousarray(c.T.astype(np.float64))
        for i in np.flatnonzero(coordinate):
            n, own = int(part[i]), q[i].astype(np.float64)
            focus = np.argpartition(-np.abs(own), FOCUS)[:FOCUS]
            some = by_place[focus, :n]
            rest_c = np.sqrt(np.maximum(cn[:n] ** 2 - (some**2).sum(axis=0), 0))
            rest_q = np.sqrt(max(float(qn[i] ** 2 - (own[focus] ** 2).sum()), 0.0))
            bound = own[focus] @ some + rest_q * rest_c
            left = np.flatnonzero(bound + 1e-6 * (np.abs(bound) + 1) >= floor[i])
            if len(left):
                keep(i, left, _products(q[i : i + 1], c[left])[0])
    plain = np.flatnonzero(~coordinate & (part > 0))
    plain = plain[np.argsort(part[plain], kind="stable")]
    for a in range(0, len(plain), TOGETHER):
        some = plain[a : a + TOGETHER]
        n = int(part[some[-1]])
        for i, values in zip(some, _products(q[some], c[:n]), strict=True):
            keep(i, np.arange(int(part[i])), values[: int(part[i])])
    if not rows:
        return none
    return np.concatenate(rows), order[np.concatenate(cols)], np.concatenate(scores)


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                q, c = _Block(row, "q"), _Block(row, "c")
                floor = np.full(len(q.ids), -np.inf) if row["floors"] is None else np.array(row["floors"], np.float64)
                i, j, scores = search(q.rows, q.vectors, floor, c.rows, c.ids, c.vectors, k)
                if len(i):
                    big = scores.dtype == object
                    text = pa.array([str(x) for x in scores] if big else [None] * len(i), pa.string())
                    whole = np.array([min(max(int(x), LEAST), MOST) for x in scores], np.int64) if big else scores
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.rows[i]), pa.array(q.ids[i]), pa.array(c.ids[j]), pa.array(whole), text],
                        names=["query", "query_id", "vec_id", "score", "digits"],
                    )

    return run


_FOUND = "query long, query_id long, vec_id long, score long, digits string"


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` largest inner products, ties to
    the smaller id, a query's own row left out. Both tables are parts of one table of
    ``integer_vectors``, so that rows are known by their number: rows with repeated or null ids
    are queries and candidates of their own. Vectors of different widths have no product and
    never meet; null ids come last among ties (the largest long id counts as null). Products of any size are compared exactly; a score
    beyond 64 bits is given as the nearest 64-bit integer. An empty table on either side gives an
    empty result.

    Each query block is first searched against the blocks of its width's longest vectors. The
    ``k`` th best score is its query's floor. From then on a query block asks for buckets of norms
    down to the least that any of its queries can use, so pairs beyond that are never made. Pairs
    hold numbers only, until both blocks are joined to them; each is a piece of work of fixed size.
    """
    blocks = candidates.repartitionByRange(F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    number = F.monotonically_increasing_id()
    blocks = blocks.select("row", "vec_id", "v", "norm").mapInArrow(_pack(BLOCK_ROWS, True), _PACKED)
    blocks = stored(blocks.withColumn("block", number), "blocks")
    asked = queries.select("row", "vec_id", "v", "norm").mapInArrow(_pack(QUERY_ROWS, False), _PACKED)
    asked = stored(asked.withColumn("asked", number), "asked")

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in ("item", "rows", "ids", "vectors")])

    def work(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        full = pairs.join(side(asked, "asked", "q"), "asked").join(side(blocks, "block", "c"), "block")
        full = full.join(floors, "asked") if floors is not None else full.withColumn("floors", F.lit(None).cast("array<double>"))
        return full.drop("asked", "block").mapInArrow(_score(k), _FOUND)

    # A width's longest vectors: as many of its first blocks as hold more than k rows.
    meta = blocks.select("block", "width", "bucket", "top", "n")
    hist = meta.groupBy("width", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    above = Window.partitionBy("width").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = stored(hist.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))), "buckets")
    first = Window.partitionBy("width").orderBy(F.col("top").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
    lead = meta.join(hist.where(F.col("before") <= k).select("width", "bucket"), ["width", "bucket"])
    lead = lead.withColumn("held", F.coalesce(F.sum("n").over(first), F.lit(0))).where(F.col("held") <= k)
    lead = stored(lead.select("width", "block"), "lead")
    seeded = stored(work(asked.select("asked", "width").join(lead, "width"), None), "seeded")

    own = Window.partitionBy("query").orderBy(*_order())
    kth = seeded.withColumn("place", F.row_number().over(own)).where(F.col("place") == k)
    kth = kth.select(F.col("query").alias("row"), F.col("score").cast("double").alias("low"))
    each = queries.select("row", "norm").join(kth, "row", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf"))))
    # As wide as a double may be off.
    each = each.withColumn("low", F.col("low") - F.abs("low") * 1e-12)
    listed = asked.select("asked", "width", "rows").mapInArrow(_listed, "asked long, width int, place int, row long")
    each = listed.join(each, "row")
    least = F.when(F.col("low") <= 0, 0.0).when(F.col("norm") > 0, F.col("low") / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(float("inf")))
    needs = each.groupBy("asked", "width").agg(
        F.sort_array(F.collect_list(F.struct("place", "low")))["low"].alias("floors"), F.min(least).alias("least")
    )
    needs = stored(needs, "needs")

    # Buckets that a block of queries can use, then their blocks, dealt by SPREAD of them.
    lowest = F.when(F.col("least") <= 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log2("least") * 8) - 1)
    wanted = needs.select("asked", "width", "least", lowest.alias("lowest")).join(hist.select("width", "bucket", "blocks"), "width")
    wanted = wanted.where(F.col("bucket") >= F.col("lowest"))
    parts = F.ceil(F.col("blocks") / SPREAD).cast("int")
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = meta.join(hist.select("width", "bucket", "blocks"), ["width", "bucket"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("block"), parts).cast("int")).select("width", "bucket", "part", "block", "top")
    pairs = wanted.join(dealt, ["width", "bucket", "part"]).where(F.col("top") >= F.col("least"))
    pairs = pairs.select("asked", "width", "block").join(lead.select("block"), "block", "left_anti")
    found = seeded.union(work(pairs, needs.select("asked", "floors")))
    return (
        found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        .select(*[F.nullif(c, F.lit(MOST)).alias(c) if c.endswith("id") else c for c in ("query_id", "rank", "vec_id", "score")])
    )


def _order() -> list[Column | str]:
    """By falling score, then id. Scores beyond 64 bits by sign, number of digits, and digits."""
    digits = F.coalesce("digits", F.lit(""))
    size, up = F.length(F.ltrim(digits, F.lit("-"))), F.col("score") > 0
    long = F.when(F.col("digits").isNull() | F.col("score").between(LEAST + 1, MOST - 1), 0)
    return [
        F.col("score").desc(),
        long.otherwise(F.when(up, -size).otherwise(size)),
        F.when(long.isNull() & up, digits).desc_nulls_last(),
        F.when(long.isNull() & ~up, digits).asc_nulls_last(),
        "vec_id",
    ]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block of queries, with their places."""
    for batch in batches:
        for asked, width, raw in zip(*[batch.column(c).to_pylist() for c in ("asked", "width", "rows")], strict=True):
            rows = np.frombuffer(raw, np.int64)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, asked)), pa.array(np.full(n, width, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(rows)],
                names=["asked", "width", "place", "row"],
            )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
