"""Scalar operators on streams: they hold no state, so a streaming DataFrame takes them as a batch one does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply(stream: DataFrame, **columns: Callable[[], Column] | Column) -> DataFrame:
    return stream.withColumns({name: c() if callable(c) and not isinstance(c, Column) else c for name, c in columns.items()})


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to Parquet, exactly once a file; ``once`` ends when all that is there is done."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
