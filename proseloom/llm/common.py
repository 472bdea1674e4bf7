"""Helpers the training-data operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

# Rows of one batch, of Arrow's or of Parquet's reader: whole texts travel in it, so it stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one batch, of Arrow's and of Parquet's reader, as whole texts of any length travel in it."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(name)) > BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def ship(spark: SparkSession, path: str) -> str:
    """Send a bounded model file to every executor, also to those that join later."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    return SparkFiles.get(name)


_RESIDENT: dict = {}


def resident(key, make):
    """What an operator keeps in a Python worker between tasks; that of another operator leaves for it."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column; null counts as empty."""
    for value in column.to_pylist():
        yield value or ""


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets between them."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit depends on every bit."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that lost executors cost no long recomputing."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared checkpoint folder, and the folder, for ``discard``."""
    folder = f"{checkpoint_dir(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
