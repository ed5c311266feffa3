"""Fitted operators on streams: their transforms are projections and joins with static tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import Operator
from ..sources.tables import scratch


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, with the columns of a static frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_stream(stream: DataFrame, operator: Operator, out: str, checkpoint: str, once: bool = True):
    """Writes the transformed stream as Parquet; exactly once, as files and checkpoint are both kept. With once it ends
    when all files that are there have been read."""
    writer = operator.transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streamed(stream: DataFrame, operator: Operator) -> DataFrame:
    """The transform of all files of the stream that are there, as a table in the shared folder: the executors write its
    rows, and none pass through the driver."""
    spark = stream.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    write_stream(stream, operator, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema(operator.transform(stream).schema).parquet(f"{base}/rows")
