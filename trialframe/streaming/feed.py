"""Streaming sources and a runner that drains a stream into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trialframe.schemas import RESULT_JSON_SCHEMA, RESULT_SCHEMA
from trialframe.sources.readers import with_times


def parquet_stream(
    spark: SparkSession, path: str, schema: T.StructType,
    name_filter: str = "*.parquet", files_per_trigger: int | None = None,
) -> DataFrame:
    """New Parquet files of a directory, in bounded micro-batches if asked."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def result_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New result files (one JSON record each); ``.tmp`` files are never read."""
    reader = (
        spark.readStream.schema(RESULT_JSON_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_times(reader.json(path), RESULT_SCHEMA)


def deduplicated(
    results: DataFrame, time_column: str = "completed_at", delay: str = "1 hour",
    keys: tuple[str, ...] = ("run_id",),
) -> DataFrame:
    """Each run once; rows later than the watermark are dropped."""
    return results.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(
        list(keys)
    )


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, then stop."""
    query = (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Append a stream to Parquet under ``root`` and return the table."""
    out = f"{root}/rows"
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    drain(writer, f"{root}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], root: str,
    mode: str = "append",
) -> None:
    """Hand each micro-batch to ``handle``; it must tolerate a repeated batch."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle)
    drain(writer, f"{root}/checkpoint")
