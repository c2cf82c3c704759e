"""Intermediate tables in the folder that a session's driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch.
ARROW_BYTES = 12 << 20
_ARROW_KEY, _NO_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 28

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` where it
    is set. Where it isn't (a local session, as in tests) a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sidewise-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_written() -> None:
    for spark, folder in _written:
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001  the session has ended; the shared folder's owner cleans up
            return


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later step reads."""
    for df in tables:
        _written.remove((df.sparkSession, df._stored_in))
        _delete(df.sparkSession, df._stored_in)


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """From now on what Spark hands to Python at once is bounded by bytes too, where the session
    leaves that open."""
    if int(spark.conf.get(_ARROW_KEY, str(_NO_BOUND))) >= _NO_BOUND:
        spark.conf.set(_ARROW_KEY, str(most))


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks it was running. Removed when the program ends, or
    before by ``release``. ``options`` go to the writer."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, folder))
    df.write.option("compression", "zstd").options(**(options or {})).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a partition sorted by its first column, a number, cut such that no group of equal
    numbers is parted. A table holds as many groups as a batch does, one at least."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, keys = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
        if held and keys[0] != key:
            yield pa.concat_tables(held)
            held = []
        key = keys[-1]
        cut = int(np.searchsorted(keys, key))
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held)
