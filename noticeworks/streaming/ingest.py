"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stream of a Parquet table in the folder, with that table's schema; times without a zone are the session's."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def distinct_within(stream: DataFrame, keys: Sequence[str], at: str, delay: str = "48 hours") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, at: str, window: str, keys: Sequence[str], *aggregates: Column, delay: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, window), *keys).agg(*aggregates)
    return counted.select(F.col("window.start").alias("window_start"), *[c for c in counted.columns if c != "window"])


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is now, to files in the shared folder, and reads them back.

    Each micro-batch has a folder of its own that a repeated batch overwrites, so retries add nothing; in update and
    complete mode the last batch is the result.
    """
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'last' if mode == 'complete' else f'batch={number}'}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()
    return spark.read.schema(stream.schema).parquet(f"{out}/{'last' if mode == 'complete' else 'batch=*'}")
