"""Upkeep of atom counts over a stream of rows: an extension. Counts add up, so each micro-batch
is aggregated on its own and written under its number; a batch that is run again overwrites
itself, and the total is a sum over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import atoms


def maintain(stream: DataFrame, names: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        atoms(batch, names).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, names: Sequence[str], folder: str) -> DataFrame:
    """Distinct rows of features with their number ``w`` over all batches."""
    return spark.read.parquet(folder).groupBy(*names).agg(F.sum("w").alias("w"))
