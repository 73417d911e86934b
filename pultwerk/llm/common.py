"""Helpers of several operators: written intermediate tables and Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.session import shared_dir

U64 = np.uint64


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``stored``, with the folder for a table that is to be removed after use."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back, so that lost executors never recompute it."""
    return written(df, name)[1]


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nobody holds any more.

    They are kept until the driver's garbage collector finds the plan gone; where each step's
    result is written, that may be long after the last use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spare(columns: list[str], name: str) -> str:
    """A column name that the table does not have yet; names differ by more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(name: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def queue_key(column: Column) -> Column:
    """A key that keeps null apart from every string."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column.cast("string")))


# rows of a narrow table (ids and small numbers) that are sent to every executor at most,
# under 100 MB; more go through a shuffle
BROADCAST_ROWS = 2_000_000


def small_or_shuffled(narrow: DataFrame) -> DataFrame:
    """Marks a narrow written table for broadcast if its counted size allows it."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


@functools.cache
def _trim():
    """glibc's call that hands freed memory back to the system, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


# rows of an Arrow batch while rows carry whole texts
TEXT_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, so that a task never holds thousands of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Short parts of the batches, so that what a task makes of one stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
        del whole
        # a worker lives on with the next stage's task, beside other workers
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls and the border of each value, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), borders


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))
