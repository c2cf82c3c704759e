"""What the operators of this folder share: inputs, texts, running totals."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import bounded_batches, release, stored

__all__ = ["bounded_batches", "release", "stored"]

#: White space between words, as bytes and inside a regular expression's brackets.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CHARS = SPACE_BYTES.decode("ascii")
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEWLINE = "\n"

def _give_back() -> None:
    """Return what is free to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose memory goes back to the system at the task's end."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(col, UPPER, LOWER)


def hash128(col: Column) -> list[Column]:
    """Two 64-bit hashes of a string column. The second goes through the text from a seed of its
    own, so texts that collide in one don't in the other."""
    return [F.xxhash64(col), F.xxhash64(F.lit(0x5EED), col)]
