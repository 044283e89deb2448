"""Streams of documents through operators that need no state: a stream's result equals the batch's.

An extension: documents arrive as files, results leave by foreachBatch or any
streaming sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocks, lines


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files: int = 100) -> DataFrame:
    """A stream of new Parquet files of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def metrics(stream: DataFrame) -> DataFrame:
    return lines.metrics(stream)


def converted(stream: DataFrame) -> DataFrame:
    return blocks.to_markdown(stream)


def sink(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run once over all that is there, in batches; write gets each batch and its number, which makes it repeatable."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
