"""Chapters that arrive while a query runs, and the streaming form of merged gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of rows from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan over each micro-batch. Each batch has a folder of its own, which a repeated one replaces."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    """(keys, start, end, n): runs of events no further apart than the gap; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
