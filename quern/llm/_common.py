"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that Python code handles at once; an Arrow batch with more is cut into slices.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python; both sides hold a few at a time.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (in tests) a local one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most ``limit`` bytes of the column ``text``, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def ready(spark: SparkSession) -> None:
    """Makes sure that Arrow batches in this session have no more than ``ARROW_BYTES`` or one row, and that Python
    workers find this package, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in f"{env.get('PYTHONPATH', '')}:{os.environ.get('PYTHONPATH', '')}".split(":"):
        env["PYTHONPATH"] = f"{env.get('PYTHONPATH', '')}:{root}".strip(":")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_slices(df: DataFrame, text: str, schema: T.StructType, each: Callable[[pa.RecordBatch], dict | None], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded bytes; ``each`` turns one slice into columns of ``schema``."""
    names = schema.fieldNames()
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_type(schema)
        for part in slices(batches, text, limit):
            if out := each(part):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, types.field(n).type) for n, x in ((n, out[n]) for n in names)], schema=types)

    return df.mapInArrow(run, schema)


def crc32_le(ids: np.ndarray) -> int:
    from zlib import crc32

    return crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
