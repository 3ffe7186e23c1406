"""Selection over unbounded tables, by Structured Streaming.

The predicate is lowered as for a batch. A selection keeps no state, so there is nothing to bound by a
watermark: rows pass once, and the checkpoint location makes restarts exactly-once up to the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.operators.selection import plan
from quern.plans import ast
from quern.sources.files import is_file


def table_stream(spark, path: str, schema: T.StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files (or one file) as a stream: files that arrive are read once."""
    reader = spark.readStream.schema(schema)
    if is_file(spark, path):
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def select_stream(stream: DataFrame, where: ast.Predicate | str) -> DataFrame:
    """The rows of the stream for which the predicate is true."""
    return stream.where(plan(stream, where))


def for_each_batch(stream: DataFrame, where: ast.Predicate | str, callback: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Calls back with each micro-batch of matching rows and its number; an error in a batch ends the query.

    ``available_now`` works off what is there and ends; ``every`` is a processing-time interval."""
    writer = select_stream(stream, where).writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def append_to(stream: DataFrame, where: ast.Predicate | str, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Appends matching rows to a folder of parquet files, exactly once."""
    writer = select_stream(stream, where).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
