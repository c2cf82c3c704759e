"""Token ids in Parquet files that can be read selectively (operator 3)."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table, task

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Rows of a row group stay near this size, so that a reader skips what it doesn't want.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


@task
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from .encoding import encoder, slices, with_end

    part, place, at = TaskContext.get().partitionId(), 0, 0
    enc = encoder(TOKENIZER, "lead")
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            n = b - a
            flat, ends = with_end(*enc.encode_many(texts.slice(a, n)), END_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(place, place + n, dtype=np.int64)),
                    pa.array(at + ends[:-1].astype(np.int64)),
                    ids.slice(a, n),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))),
                ],
                names=["part", "place", "at", "doc_id", "n_tokens", "ids"],
            )
            place += n
            at += len(flat)


def write_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """Encode every whole text (null: empty), end each with ``END_ID``, write the ids as Parquet
    in ascending order of the id and return a reader of the files: ``part`` (number of the range
    of ids), ``place`` (row within it), ``at`` (ids of the range before it), ``doc_id``,
    ``n_tokens``, ``ids array<int>``.

    Ids have a dictionary, the sorted numbers are delta-encoded, row groups end near
    ``row_group_bytes`` and pages near ``page_bytes``, with page indexes: ``read_documents`` and
    ``read_positions`` touch only the pages they want, and sums read ``n_tokens`` alone. Repeated
    ids are all kept, in the order of their texts; null ids come first. Very long texts are
    encoded whole. Other columns are ignored. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = ordered.mapInArrow(_encode, "part int, place long, at long, doc_id long, n_tokens long, ids array<int>")
    options = {
        "compression": "snappy",  # packed ids gain little from more
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("place", "at", "doc_id", "n_tokens")},
    }
    return stored(rows, "tokens", {k: str(v) for k, v in options.items()})


def read_documents(files: DataFrame, first: int, last: int) -> DataFrame:
    """``doc_id, ids`` of the documents with ids from ``first`` to ``last``. Spark hands the
    bounds to the files' readers, which skip row groups and pages by their least and largest id."""
    return files.where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def read_positions(files: DataFrame, start: int, stop: int) -> DataFrame:
    """``doc_id, start, ids``: the ids at places ``start`` to ``stop`` (not included) of all ids
    in order, by document. The driver gets where each file's range of ids begins, one row a file;
    within a file Spark skips row groups and pages by the places they hold."""
    found = None
    for r in sorted(_bases(files).collect()):
        a, z = max(0, start - r["base"]), stop - r["base"]
        if a >= r["total"] or z <= 0 or a >= z:
            continue
        rows = files.where((F.col("part") == r["part"]) & (F.col("at") < z) & (F.col("at") + F.col("n_tokens") > a))
        skip = F.greatest(F.lit(a) - F.col("at"), F.lit(0))
        n = F.least(F.lit(z) - F.col("at"), F.col("n_tokens")) - skip
        rows = rows.select(
            "doc_id", (F.lit(r["base"]) + F.col("at") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), n.cast("int")).alias("ids")
        )
        found = rows if found is None else found.union(rows)
    none = files.select("doc_id", F.lit(0).cast("long").alias("start"), "ids").limit(0)
    return none if found is None else found


def _bases(files: DataFrame) -> DataFrame:
    """``part, base, total``: ids before each range, and in it. One row for each range meets in
    a single task."""
    sizes = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    return sizes.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"), "total")


@task
def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        raw = memoryview(flat.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("part", "at", "doc_id", "n_tokens")], pa.array(sums, pa.int64())],
            names=["part", "at", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_digest(files: DataFrame) -> DataFrame:
    """Per document of ``write_tokens``' files: where its ids start among all ids, how many
    there are, and their checksum."""
    rows = files.select("part", "at", "doc_id", "n_tokens", "ids").mapInArrow(_checksums, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    # One row for each range, as many as tasks wrote them, whatever the number of rows.
    out = rows.join(F.broadcast(_bases(files)), "part")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(write_tokens(table(spark, sf_dir, "documents")))
