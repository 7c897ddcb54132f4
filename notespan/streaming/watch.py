"""Watched folders (SRC3 to SRC5) as file streams, and stages run on each new batch.

What is already there is read too, and a checkpoint keeps a file from being read
twice after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import event_id


def stream_texts(spark: SparkSession, path: str, glob: str = "*.txt", files_per_batch: int = 1000) -> DataFrame:
    """SRC3: event_id, text of each new file."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(event_id(path).alias("event_id"), F.col("value").alias("text"))


def stream_binary(spark: SparkSession, path: str, glob: str = "*.rtf", files_per_batch: int = 1000) -> DataFrame:
    """SRC4."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(event_id(path).alias("event_id"), "content")


def run(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """SRC5: ``stage`` on every batch, appended to the Parquet table ``sink``; a batch that is run again replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
