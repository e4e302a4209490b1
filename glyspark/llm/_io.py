"""Shared-folder workspaces and Arrow helpers for the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


_open: dict[str, list[Workspace]] = {}


def release(spark: SparkSession) -> None:
    """Delete all folders of this application's operators, once their results are not needed any more."""
    for work in _open.pop(spark.sparkContext.applicationId, []):
        work.drop("")


class Workspace:
    """A folder below spark.checkpoint.dir, which all executors share.

    Tables written here cut lineage and survive lost executors. Where the setting is absent, a local session takes a
    folder below the system's temp folder; on a cluster, whose machines would not share it, that is an error.
    Results read from it, so it stays until release() or the caller's own clean-up.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.gettempdir()}/spark-checkpoints"
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        ship(spark)
        _open.setdefault(spark.sparkContext.applicationId, []).append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back with the schema it had."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def free(self) -> None:
        """Let Spark remove the shuffle files of finished steps now, not when the driver's memory fills."""
        gc.collect()
        trim()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}" if n else self.root)
            path.getFileSystem(conf).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, wherever Spark's file systems reach."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and n + 1 offsets; null counts as empty."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows (lo, hi) of about `most` bytes each; a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    trim()


def trim() -> None:
    """Give memory of finished batches back; workers are reused for many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
