"""Continuous indexing, beyond the batch form: a Parquet stream of files, each micro-batch brought into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.index import Index
from ..schema import FILES


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """files (with ts) without repeats of (path, hash) within ten minutes."""
    raw = spark.readStream.schema(FILES + ", ts timestamp").parquet(folder)
    return raw.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["path", "hash"])


def run(stream: DataFrame, index: Index, checkpoint: str):
    """Starts the query; files that a batch doesn't hold stay in the index."""

    def step(batch: DataFrame, _: int) -> None:
        index.update(batch.drop("ts").dropDuplicates(["path"]), partial=True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
