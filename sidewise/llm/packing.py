"""Best-fit packing of token sequences by exact complements (operator 5)."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table, task

TOKENIZER = "word_bpe_49k.json"
END_ID = 0
CAPACITY = 2048


@task
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, numbered by length within the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from .encoding import encoder, slices, with_end

    part, seen = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
    names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "place"]
    enc = encoder(TOKENIZER, "drop")
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            flat, ends = with_end(*enc.encode_many(texts.slice(a, b - a)), END_ID)
            total = np.diff(ends)
            n = -(-total // CAPACITY)
            owner = np.repeat(np.arange(b - a), n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * CAPACITY
            length = np.minimum(total[owner] - start, CAPACITY)
            raw, at = memoryview(flat.tobytes()), ends[owner] + start
            sums = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, first, each = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(first, each) + np.repeat(seen[sizes], each)
            seen[sizes] += each
            columns = [
                pa.array(np.full(len(owner), part, np.int32)), docs.slice(a, b - a).take(pa.array(owner)),
                pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(place),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class Sums:
    """Index of the sums of one, two and three available lengths.

    A sum's entry is the combination with the largest first length that may still be available.
    Counts only fall, so an entry that has become unavailable moves on and never returns: all
    look-ups together pass each combination of two lengths, or of a length and an indexed pair,
    once."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = int(n)
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def take(self, lengths: list[int], times: int = 1) -> None:
        for x in lengths:
            self.left[x] -= times

    def pair(self, total: int, top: int | None = None) -> tuple[int, int] | None:
        """Two lengths of sum ``total``, the larger one at most ``top``, or as the index has it."""
        left = self.left
        a = self.pairs.get(total, total - 1) if top is None else min(top, total - 1)
        while 2 * a >= total and not (left[a] and left[total - a] and (2 * a > total or left[a] > 1)):
            a -= 1
        if top is None:
            self.pairs[total] = a
        return (a, total - a) if 2 * a >= total and a > 0 else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths of sum ``total``, the largest first."""
        left, a = self.left, self.triples.get(total, total - 2)
        found = None
        while found is None and 3 * a >= total:
            if left[a]:
                rest = total - a
                best = self.pair(rest)
                if best and best[0] > a:  # smaller first lengths have it
                    best = self.pair(rest, a)
                while best and left[a] < 1 + best.count(a):
                    best = self.pair(rest, best[0] - 1)
                found = best and (a, *best)
            if found is None:
                a -= 1
        self.triples[total] = a
        return found

    def filling(self, gap: int) -> list[int] | None:
        """At most three available lengths whose sum is ``gap``."""
        if self.left[gap]:
            return [gap]
        more = self.pair(gap) or self.triple(gap)
        return list(more) if more else None


def fill_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """How to fill sequences, from the number of pieces of each length.

    Lengths are taken from the longest down. The gap it leaves is filled exactly by one, two or
    three available lengths, if the index of sums has such a combination, else by the longest that
    fits, again and again. A filling is used as often as the counts allow, so there are few more
    fillings than lengths.

    Rows: length, first piece (by number within the length), fillings, pieces of that length in
    each filling, number of the first sequence, offset of its first piece there.
    """
    index = Sums(counts, capacity)
    left = index.left
    rows, used, sequence = [], [0] * (capacity + 1), 0
    length = capacity
    while length:
        if not left[length]:
            length -= 1
            continue
        index.take([length])
        filling = [length]
        while (gap := capacity - sum(filling)) > 0:
            more = index.filling(gap)
            if more is None:
                fits = next((x for x in range(gap, 0, -1) if left[x]), 0)
                if not fits:
                    break
                more = [fits]
            filling += more
            index.take(more)
        each = Counter(filling)
        times = 1 + min(left[x] // k for x, k in each.items())
        offset = 0
        for size, k in sorted(each.items(), reverse=True):
            rows.append((size, used[size], times, k, sequence, offset))
            used[size] += times * k
            offset += size * k
        index.take(filling, times - 1)
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every piece of every document into a sequence of at most ``CAPACITY`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty
    text is one piece that holds the end id; a very long text is cut into full pieces and a rest.
    Repeated and null ids are packed as documents of their own. Other columns are ignored; an
    empty table gives an empty one. The driver sees one count for
    each length (``CAPACITY`` at most); pieces find their place by their number within a length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, place long"
    pieces = stored(source.mapInArrow(_cut, schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(fill_plan(histogram))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = rows[np.searchsorted(key, length << 44 | number, side="right") - 1]
            at = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(row[:, 4] + at // row[:, 3]),
                    pa.array(row[:, 5] + at % row[:, 3] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(counts.select("part", "length", "base"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("number")
    )
    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
