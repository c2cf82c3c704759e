"""Removal of repeated passages by fixed-block anchors (operator 6).

Any window of 20 words holds a whole block of 10 words that begins at a multiple of 10 in its
own document. So the blocks of every document are indexed and every rolling run of 10 words
probes the index. A hit is extended to both sides by all windows of 20 words around it; those
that also begin earlier elsewhere are removed. Windows that overlap run together, so what is
removed are the maximal exact repeats.

Texts lie in batches, and a few consecutive batches are the unit of all exchange: each sends a
distinct run or window once, so a passage that a third of all documents share weighs one entry
for each such group. Indexes are dealt by ranges of hashes, as many as keep each at a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import bounded_batches, stored, table, task

WINDOW = 20
BLOCK = WINDOW // 2
#: Bytes of text in a batch (a longer text is a batch of its own), and batches of a group.
BATCH_BYTES = 1 << 20
GROUP = 8
#: Entries that an index range holds on average.
RANGE_ENTRIES = 1_000_000
#: Bits of a run's hash that probe the index, at least. What they wrongly hit is compared in vain.
KEY_BITS = 40

_HITS = "owner long, n long, keys binary"


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, so that planes of zeros compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _sorted_planes(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted_values(raw: bytes) -> np.ndarray:
    return np.cumsum(_values(raw), dtype=np.uint64)


def _ranges(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hash values begins among sorted keys, and the end."""
    limits = np.array([(k << bits) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def _batches(size: int):
    """Documents in batches, in order of their ids, each with one compressed text."""

    @task
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _filled(rows, size)

    return run


def _filled(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    part, number, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=6)
    for batch in rows:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, texts = ids[order], batch.column(1).take(pa.array(order))
        raw, offsets = hashing.buffers(texts)
        for a, b in hashing.chunks(offsets, size):
            some, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number], pa.int64()),
                    pa.array([len(hashing.word_bounds(some, ends)[0])], pa.int64()),
                    pa.array([ids[a:b].astype(np.int64).tobytes()]),
                    pa.array([ends.astype(np.int64).tobytes()]),
                    pa.array([pack.compress(some.tobytes())]),
                ],
                names=["batch", "n_words", "ids", "ends", "packed"],
            )
            number += 1


class _Words:
    """A batch's words and runs."""

    def __init__(self, row: dict) -> None:
        self.batch = row["batch"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.frombuffer(row["ends"], np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["packed"]) if self.offsets[-1] else b""
        self.raw = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends, self.counts = hashing.word_bounds(self.raw, self.offsets)
        self.words = hashing.hash_words(self.raw, self.starts, self.ends)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.counts, at, side="right") - 1

    def begin(self, n: int) -> np.ndarray:
        """Where runs of ``n`` words within a document begin."""
        fits = np.ones(max(len(self.words) - n + 1, 0), bool)
        for k in range(1, n):  # the k words before a document's end
            last = self.counts[1:] - k
            fits[last[(last >= 0) & (last < len(fits))]] = False
        return np.flatnonzero(fits)

    def kept(self, i: int, keep: np.ndarray) -> bytes:
        """Words of document ``i`` that stay, joined by single spaces; stretches that are
        written so already are copied whole."""
        a, b = int(self.counts[i]), int(self.counts[i + 1])
        at = np.flatnonzero(keep[a:b]) + a
        if not len(at):
            return b""
        starts, ends = self.starts[at], self.ends[at]
        same = (np.diff(at) == 1) & (starts[1:] - ends[:-1] == 1) & (self.raw[np.minimum(ends[:-1], len(self.raw) - 1)] == 0x20)
        cut = np.flatnonzero(~same)
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
        return b" ".join([self.data[x:y] for x, y in zip(starts[first].tolist(), ends[last].tolist(), strict=True)])


def _grouped(rows: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of consecutive batches of one group, as far as they lie together. A batch's words
    are made from its row one at a time."""
    held: list[dict] = []
    for batch in rows:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held and (row["batch"] // GROUP != held[0]["batch"] // GROUP or len(held) == GROUP):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _first(*keys: np.ndarray) -> np.ndarray:
    """Marks of rows that differ from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _probes(n_ranges: int, bits: int):
    """Distinct runs of BLOCK words of each group, with marks: a block's own, found repeatedly."""

    @task
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(rows):
            parts = []
            for row in group:
                words = _Words(row)
                at = words.begin(BLOCK)
                probe = ((at - words.counts[words.doc(at)]) % BLOCK != 0).astype(np.uint64)
                parts.append(hashing.hash_runs(words.words, BLOCK)[at] >> np.uint64(64 - bits) << np.uint64(1) | probe)
            marked = np.sort(np.concatenate(parts))
            if not len(marked):
                continue
            keys = marked >> np.uint64(1)
            first = np.flatnonzero(_first(keys))
            many = np.diff(np.append(first, len(keys))) > 1
            block, keys = (marked[first] & np.uint64(1)) == 0, keys[first]
            cuts = _ranges(keys, bits, n_ranges)
            full = np.flatnonzero(np.diff(cuts))
            spans = [(int(cuts[i]), int(cuts[i + 1])) for i in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array(np.full(len(full), group[0]["batch"] // GROUP, np.int64)),
                    pa.array([_sorted_planes(keys[a:b]) for a, b in spans], pa.binary()),
                    pa.array([np.packbits(block[a:b]).tobytes() for a, b in spans], pa.binary()),
                    pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
                ],
                names=["span", "owner", "keys", "block", "many"],
            )

    return run


def _gather(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All keys, and whose they are."""
    sizes = np.array([len(x) for x in keys])
    return np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)


def _send(owners: np.ndarray, keys: np.ndarray) -> dict[str, pa.Array]:
    """Keys back to their owners."""
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    found, first, sizes = np.unique(owners, return_index=True, return_counts=True)
    return {
        "owner": pa.array(found, pa.int64()),
        "n": pa.array(sizes.astype(np.int64)),
        "keys": pa.array([_sorted_planes(keys[a : a + n]) for a, n in zip(first, sizes, strict=True)], pa.binary()),
    }


def _hits(group: pa.Table) -> pa.Table:
    """Runs that match an indexed block elsewhere, for each group of batches that has them."""
    lists = [_sorted_values(x) for x in group.column("keys").to_pylist()]
    keys, owner = _gather(lists)
    flags = [
        np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(group.column(c).to_pylist(), lists, strict=True)])
        for c in ("block", "many")
    ]
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(_first(keys[order]))
    sizes = np.diff(np.append(first, len(keys)))
    block, many = (np.logical_or.reduceat(f[order], first) for f in flags)
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(block & (many | (sizes > 1)), sizes)
    return pa.table(_send(group.column("owner").to_numpy()[owner[hit]], keys[hit]))


def _joined_keys(parts: list[dict] | None) -> np.ndarray:
    return np.sort(np.concatenate([_sorted_values(x["keys"]) for x in parts])) if parts else np.zeros(0, np.uint64)


def _within(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def _windows(n_ranges: int, bits: int):
    """Distinct windows around the hits of each group, with a check of 32 more bits and the
    smallest id, then batch, that has them. Windows of its other batches are known to be later:
    those rows are of span -1 and need no exchange with other groups."""

    @task
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(rows):
            hits, parts = _joined_keys(group[0]["hits"]), []
            for row in group:
                words = _Words(row)
                at = words.begin(BLOCK)
                hit = np.zeros(len(words.words) + 1, np.int32)
                hit[at + 1] = _within(hashing.hash_runs(words.words, BLOCK)[at] >> np.uint64(64 - bits), hits)
                before = np.cumsum(hit, dtype=np.int32)
                at = words.begin(WINDOW)
                at = at[before[at + WINDOW - BLOCK + 1] > before[at]]
                if not len(at):
                    continue
                keys, first = np.unique(hashing.hash_runs(words.words, WINDOW)[at], return_index=True)
                check = (hashing.hash_runs(words.words, WINDOW, 1)[at[first]] >> np.uint64(32)).astype(np.uint32)
                parts.append((keys, check, words.ids[words.doc(at[first])], np.full(len(keys), row["batch"], np.int64)))
            if not parts:
                continue
            keys, check, ids, batches = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((batches, ids, check, keys))
            first = _first(keys[order], check[order])
            rest = order[~first]
            local = _send(batches[rest], keys[rest])
            keys, check, ids, batches = (x[order[first]] for x in (keys, check, ids, batches))
            cuts = _ranges(keys, 64, n_ranges)
            full = np.flatnonzero(np.diff(cuts))
            spans = [(int(cuts[i]), int(cuts[i + 1])) for i in full]
            n = len(local["owner"])
            none = pa.array([b""] * n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([full, np.full(n, -1)]).astype(np.int32)),
                    pa.concat_arrays([pa.array(np.full(len(full), -1, np.int64)), local["owner"]]),
                    pa.concat_arrays([pa.array(np.zeros(len(full), np.int64)), local["n"]]),
                    pa.concat_arrays([pa.array([_sorted_planes(keys[a:b]) for a, b in spans], pa.binary()), local["keys"]]),
                    *[
                        pa.concat_arrays([pa.array([pack(np.ascontiguousarray(x[a:b])) for a, b in spans], pa.binary()), none])
                        for x, pack in ((check, np.ndarray.tobytes), (ids, _planes), (batches, _planes))
                    ],
                ],
                names=["span", "owner", "n", "keys", "check", "ids", "batches"],
            )

    return run


def _later(group: pa.Table) -> pa.Table:
    """Windows that begin earlier in another group, for the batch that has them first."""
    keys = np.concatenate([_sorted_values(x) for x in group.column("keys").to_pylist()])
    check = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("check").to_pylist()])
    ids, batches = (np.concatenate([_values(x) for x in group.column(c).to_pylist()]).view(np.int64) for c in ("ids", "batches"))
    order = np.lexsort((batches, ids, check, keys))
    later = order[~_first(keys[order], check[order])]
    return pa.table(_send(batches[later], keys[later]))


def _remove(rows: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            words = _Words(row)
            at = words.begin(WINDOW)
            hashes = hashing.hash_runs(words.words, WINDOW)[at]
            order = np.argsort(hashes, kind="stable")
            again = np.zeros(len(hashes), bool)
            again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
            again |= _within(hashes, _joined_keys(row["later"]))
            # Windows that overlap run together to maximal repeats.
            cover = np.zeros(len(words.words) + 1, np.int32)
            cover[at[again]] += 1
            cover[at[again] + WINDOW] -= 1
            keep = np.cumsum(cover, dtype=np.int32)[:-1] == 0
            texts = (words.kept(i, keep) for i in range(len(words.ids)))
            texts = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in texts]
            n = np.diff(words.counts)
            kept = np.concatenate([[0], np.cumsum(keep)])[words.counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.ids), pa.array(n), pa.array(n - np.diff(kept)), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
            )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed`` and ``kept``, the words that stay joined by single
    spaces (with ``digest`` their SHA-256, ``kept_sha256``).

    A word goes if a window of ``WINDOW`` consecutive words covers it whose words also begin
    earlier: in a smaller document id, or before in the same document. Windows are judged on the
    input. Null, empty and short texts lose nothing; null ids come before all others. Of rows
    with one id, those of the same batch come in input order and others by batch. A very long
    text is a batch of its own, and takes about 30 bytes of memory for each of its bytes. Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    least = F.lit(-(1 << 63))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("doc_id"), F.col(text_col).alias("text"))
    batches = stored(source.mapInArrow(_batches(batch_bytes), "batch long, n_words long, ids binary, ends binary, packed binary"), "batches")
    spark, total = docs.sparkSession, batches.agg(F.sum("n_words")).first()[0] or 0
    spread = min(4 * spark.sparkContext.defaultParallelism, total // 50_000)
    n_ranges, bits = max(1, spread, total // RANGE_ENTRIES), min(63, max(KEY_BITS, total.bit_length() + 8))
    probes = batches.mapInArrow(_probes(n_ranges, bits), "span int, owner long, keys binary, block binary, many binary")
    hits = probes.groupBy("span").applyInArrow(_hits, _HITS)
    entry = F.collect_list(F.struct("n", "keys"))
    grouped = batches.withColumn("owner", F.expr(f"batch div {GROUP}"))
    around = grouped.join(hits.groupBy("owner").agg(entry.alias("hits")), "owner").sortWithinPartitions("batch")
    shape = "span int, owner long, n long, keys binary, check binary, ids binary, batches binary"
    windows = stored(around.drop("owner").mapInArrow(_windows(n_ranges, bits), shape), "windows")
    later = windows.where("span >= 0").groupBy("span").applyInArrow(_later, _HITS)
    later = later.union(windows.where("span < 0").select("owner", "n", "keys")).groupBy("owner").agg(entry.alias("later"))
    last = batches.join(later.withColumnRenamed("owner", "batch"), "batch", "left")
    kept = last.mapInArrow(task(lambda rows: _remove(rows, digest)), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")
    return kept.withColumn("doc_id", F.nullif("doc_id", least))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS k FROM d)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT v.doc_id, count(*) FILTER (WHERE g.k IS NOT NULL) AS n_removed, string_agg(v.word, ' ' ORDER BY v.k) FILTER (WHERE g.k IS NULL) AS text
  FROM words v LEFT JOIN gone g ON v.doc_id = g.doc_id AND v.k = g.k GROUP BY v.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
