"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import bounded_batches, release, stored, table, task
from .graph import components

WORDS = 5
#: Least likeness in hundredths.
LEAST = 75
#: A pair of likeness 0.75 shares no band with a chance of (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: All minima give low bits to the packed signature, the first BANDS * ROWS also form bands.
HASHES, BITS = 512, 2
#: Estimates have a deviation of 0.023 at 0.75; pairs four of them below aren't confirmed.
LEAST_ESTIMATE = 0.66
#: Rows of a bucket that are compared in one task; larger buckets are dealt by pairs of blocks.
BLOCK = 2000
PLANES = BITS * HASHES // 64
#: Shingle sets that a task keeps while it compares a bucket.
SET_BYTES = 64 << 20

_rng = np.random.default_rng(977)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SEND = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, planes array<long>, packed binary"


def minima(runs: np.ndarray, step: int = 512) -> np.ndarray:
    """The least value of a set under each of the hash functions; high halves count."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), step):
        values = runs[at : at + step, None] * _A
        values += _B
        np.minimum(out, values.min(axis=0), out=out)
    return out >> np.uint64(32)


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of minima: a hash of each band, and the low bits packed by bit plane."""
    bands = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for r in range(ROWS):
        key = hashing.mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    planes = [np.packbits((least >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1) for p in range(BITS)]
    return key.view(np.int64), np.concatenate(planes, axis=1).view(np.int64)


@task
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
            raw, offsets = hashing.buffers(texts)
            n = len(ids)
            count, sums = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            least = np.zeros((n, HASHES), np.uint64)
            for k, runs in hashing.sets_of_runs(raw, offsets, WORDS):
                count[k] = len(runs)
                if len(runs):
                    sums[:, k] = runs.sum(), hashing.mix64(runs).sum()
                    least[k] = minima(runs)
            keys, planes = signature(least)
            data = raw.tobytes()
            packed = [pack.compress(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(count), *map(pa.array, sums.view(np.int64)), lists(keys), lists(planes), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "planes", "packed"],
            )


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Both sides grow with the input, so neither is ever broadcast: the plan is the same at all
    sizes, and Spark can split it at hot keys."""
    return left.join(right.hint("merge"), on, how)


def estimate(x: str, y: str) -> Column:
    """Likeness from two packed signatures: equal low bits by bit counts, less those that
    agree by chance."""
    half = HASHES // 64
    differ = [
        F.bit_count(
            reduce(Column.bitwiseOR, [F.get(x, p * half + h).bitwiseXOR(F.get(y, p * half + h)) for p in range(BITS)])
        )
        for h in range(half)
    ]
    chance = 1 / (1 << BITS)
    return (1 - reduce(Column.__add__, differ) / HASHES - chance) / (1 - chance)


@task
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose full sets are like enough. Rows of one ``a`` follow each other."""
    unpack = zstandard.ZstdDecompressor()

    def runs(blobs: list[bytes]) -> list[np.ndarray]:
        texts = [unpack.decompress(x) for x in blobs]
        ends = np.cumsum([0, *map(len, texts)])
        return [x for _, x in hashing.sets_of_runs(np.frombuffer(b"".join(texts), np.uint8), ends, WORDS)]

    last, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            keep = []
            others = runs(some.column("packed_b").to_pylist())
            for k, (a, other) in enumerate(zip(some.column("a").to_pylist(), others, strict=True)):
                if a != last:
                    last, own = a, runs([some.column("packed_a")[k].as_py()])[0]
                same = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * same >= LEAST * (len(own) + len(other) - same))
            yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``pairs`` (a, b): near by signature first, then on full sets."""
    of = lambda x: heads.select(
        F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("planes").alias(f"planes_{x}")
    )
    near = _joined(_joined(pairs, of("a"), "a"), of("b"), "b").where(
        (estimate("planes_a", "planes_b") >= LEAST_ESTIMATE)
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * LEAST)
    )
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("packed").alias(f"packed_{x}"))
    both = _joined(_joined(near.select("a", "b"), text("b"), "b"), text("a"), "a")
    both = both.select("a", "b", "packed_a", "packed_b")
    return stored(both.mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = tuple(key[a].tolist())
            if last is not None and own != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = own
    if held:
        yield pa.concat_tables(held)


def _near_pairs(group: pa.Table) -> list[tuple[float, int, int]]:
    """Rows of a bucket that are near by signature and lie in different components, the nearest
    first. A pair that shares an earlier band was seen there."""
    component, block, n = (group.column(c).to_numpy() for c in ("component", "block", "n_shingles"))

    def lists(name: str, width: int) -> np.ndarray:
        x = group.column(name).combine_chunks()
        return x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()].view(np.uint64).reshape(-1, width)

    planes = lists("planes", PLANES).reshape(-1, BITS, HASHES // 64)
    bands = lists("bands", BANDS)
    at_band = int(np.flatnonzero(bands[0] == group.column("band")[:1].to_numpy().view(np.uint64)[0])[0])
    within = len(set(block.tolist())) == 1
    chance, found = 1 / (1 << BITS), []
    for at in range(0, len(component), 64):
        some = slice(at, at + 64)
        differ = np.zeros((len(component[some]), len(component), HASHES // 64), np.uint64)
        for p in range(BITS):
            differ |= planes[some, None, p] ^ planes[None, :, p]
        likeness = (1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / HASHES - chance) / (1 - chance)
        fit = (likeness >= LEAST_ESTIMATE) & (component[some, None] < component[None, :])
        if not within:
            fit &= block[some, None] != block[None, :]
        fit &= 100 * np.minimum(n[some, None], n[None, :]) >= LEAST * np.maximum(n[some, None], n[None, :])
        i, j = np.nonzero(fit)
        new = ~(bands[i + at, :at_band] == bands[j, :at_band]).any(axis=1)
        i, j = i[new], j[new]
        found += zip(likeness[i, j].tolist(), (i + at).tolist(), j.tolist(), strict=True)
    return sorted(found, reverse=True)


@task
def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within buckets. Pairs are confirmed on full sets from the
    nearest on; those whose components a link has joined meanwhile need no test."""
    unpack = zstandard.ZstdDecompressor()
    for group in _groups(batches, ["band", "x", "y"]):
        found = _near_pairs(group)
        if not found:
            continue
        packed, ids, component = group.column("packed"), group.column("b").to_pylist(), group.column("component").to_pylist()
        sets: dict[int, np.ndarray] = {}
        top: dict[int, int] = {}

        def set_of(k: int, packed: pa.ChunkedArray = packed, sets: dict[int, np.ndarray] = sets) -> np.ndarray:
            if k not in sets:
                if len(sets) % 256 == 255 and sum(x.nbytes for x in sets.values()) > SET_BYTES:
                    sets.clear()
                text = np.frombuffer(unpack.decompress(packed[k].as_py()), np.uint8)
                sets[k] = next(hashing.sets_of_runs(text, np.array([0, len(text)]), WORDS))[1]
            return sets[k]

        def of(x: int, top: dict[int, int] = top) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        links = []
        for _, i, j in found:
            p, q = of(component[i]), of(component[j])
            if p == q:
                continue
            one, two = set_of(i), set_of(j)
            same = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * same >= LEAST * (len(one) + len(two) - same):
                top[q] = p
                links.append((ids[i], ids[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def _across(stars: DataFrame, heads: DataFrame, texts: DataFrame, reached: DataFrame) -> DataFrame:
    """Links (a, b) that join components within buckets."""
    labelled = _joined(stars.select("band", "b").distinct(), reached.toDF("b", "component"), "b", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "b"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n"))
    mixed = mixed.where("p < q").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = _joined(labelled, mixed, "band")
    rows = _joined(rows, heads.withColumnRenamed("doc_id", "b"), "b")
    rows = _joined(rows, texts.withColumnRenamed("doc_id", "b"), "b")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    rows = rows.select("band", "x", "y", "b", "component", "block", "n_shingles", "bands", "planes", "packed")
    dealt = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "b")
    return stored(dealt.mapInArrow(_joining, "a long, b long").distinct(), "joining")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``.

    A text's set holds its distinct runs of five words, A-Z lower-cased (of fewer words: the
    whole). Texts are linked from a likeness of 0.75; a component is what links reach and its
    smallest id is kept. Null, empty and blank texts have an empty set and stand alone. Rows of
    one id count as one document that is linked to whatever any of them is linked to. A row with
    a null id is a document of its own: it is linked to none, has a null component and is kept.
    Very long texts are shingled whole. Other columns are ignored, whatever their names; an empty
    table gives an empty one. A set is one of 64-bit hashes of its runs; equal sets are known by
    their size and two 64-bit sums.

    Equal sets are one class from the start, so copies never meet as pairs. In each band bucket
    all classes are first paired with the smallest only. Buckets that still hold several
    components are then compared within themselves, block by block, by signature and on full
    sets. So every candidate pair is confirmed, refuted or within one component, whatever the
    size of a bucket, and no table of pairs grows with the square of one.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stored(source.mapInArrow(_describe, _SEND), "described")
    described = every.where("doc_id is not null")
    sets = every.select("doc_id", "n_shingles", "s1", "s2")
    classes = sets.where("doc_id is not null and n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("head"))
    classes = stored(classes, "classes")  # so that Spark can split the part of a class with many members
    members = stored(_joined(sets, classes, ["s1", "s2", "n_shingles"], "left").drop("s1", "s2"), "members")
    heads = members.where("doc_id = head").select("doc_id").distinct()
    signatures = described.where("n_shingles > 0").select("doc_id", "n_shingles", "bands", "planes")
    heads = stored(_joined(signatures, heads, "doc_id"), "heads")

    rows = heads.select(F.col("doc_id").alias("b"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a < z").select("band", "a")
    stars = stored(_joined(rows, buckets, "band").select("band", "a", "b"), "stars")
    wanted = stars.select(F.col("b").alias("doc_id")).distinct()
    texts = stored(_joined(described.select("doc_id", "packed"), wanted, "doc_id"), "texts")
    links = _confirmed(stars.where("a < b").select("a", "b").distinct(), heads, texts)
    final = components(links, "a", "b")
    more = _across(stars, heads, texts, final)
    if not more.isEmpty():
        final = components(links.union(more), "a", "b")
    release(every, classes, heads, stars, texts, links, more)
    out = _joined(members, final.select(F.col("node").alias("head"), "component"), "head", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)
), either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, either.y FROM reach JOIN either ON either.x = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""
