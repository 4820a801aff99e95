"""Shared plumbing of the corpus operators: shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dredge.llm import kernel

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from the session's spark.checkpoint.dir.

    Only where that is unset (local tests) a temporary folder is set for the session.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Bytes of an Arrow batch that a task holds on both sides.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, for the memory of executors and their workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a table that outlives executors.

    Afterwards the driver's garbage is collected so that Spark's cleaner frees the shuffle files of
    the job that has just ended; they are no longer needed.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def int64(col: pa.Array) -> np.ndarray:
    """Values of an integer column; null becomes the least long (callers filter or mask it)."""
    if col.null_count:
        col = col.cast(pa.int64()).fill_null(-(2**63))
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def gather(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices buf[start:start+len] end to end, and their offsets."""
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lens)
    return buf[index], offs


def binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Arrow binary array of slices that lie end to end."""
    return pa.Array.from_buffers(
        pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def settle() -> None:
    """Give memory that a finished task has freed back to the system: workers are reused and live long."""
    kernel.release()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        settle()

    return df.mapInArrow(run, schema)
