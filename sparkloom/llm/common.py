"""Helpers shared by the training-data operators: reading tables, cutting lineage, packing Arrow rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the word contracts call white space.
WHITE_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    if not getattr(sc, "_sparkloom_dir", None):  # one machine: any folder is shared
        sc._sparkloom_dir = tempfile.mkdtemp(prefix="sparkloom-")
    return sc._sparkloom_dir


class Stored:
    """A table written to the shared folder, which cuts the lineage; drop() deletes it when no plan needs it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        # one folder an application, so that what stays there can be deleted with it (storage.clear)
        self.path = f"{shared_dir(self.spark)}/sparkloom-{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    @classmethod
    def of(cls, other: Stored, df: DataFrame) -> Stored:
        """The same files, seen as df."""
        made = cls.__new__(cls)
        made.spark, made.path, made.df = other.spark, other.path, df
        return made

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of rows; Spark's default of 10,000 can be gigabytes of long ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that no object holds any more go now, not when the driver next collects its garbage."""
    for _ in range(2):  # what the first round frees holds more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


_caches: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Python workers are used again by other operators: what those have cached goes when another one begins. clear
    empties the owner's own caches; it is kept for the next one that claims."""
    others = [_caches.pop(name) for name in [*_caches] if name != owner]
    for other in others:
        other()
    _caches[owner] = clear
    if others:
        trim()


def trim() -> None:
    """What a Python worker has freed goes back to the system, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of whole numbers, as rows of bytes."""
    return np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :n]


def number(rows: np.ndarray) -> np.ndarray:
    """The whole numbers of rows of up to eight bytes."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64).ravel()


def packed(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of rows of bytes; ends: where the stretches end."""
    offsets = (np.r_[0, ends] * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can clash with nothing."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])
