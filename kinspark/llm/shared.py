"""Plumbing that the operators of this subpackage share.

Everything that outlives one stage goes to the folder the cluster names in
``spark.checkpoint.dir``: executors come and go, their local disks with them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinspark.operators.graph import shared_dir

#: Text bytes that one numpy pass works on; bounds the workers' scratch memory.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch between the JVM and a Python worker, where the session does not set it (Spark's 10000 whole documents are many MB).
BATCH_ROWS = 1000


def working_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/kinspark-{uuid.uuid4().hex}/{name}"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("kinspark_scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Working tables stored inside are deleted at the end, but for what the given function stores: results that outlive them."""
    outer, own = _scopes.get(), []
    token = _scopes.set((*outer, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _scopes.set(outer)
        try:
            return stored(df, name)
        finally:
            _scopes.reset(inner)

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a columnar working table to the shared folder and read it back."""
    spark = df.sparkSession
    path = working_path(spark, name)
    schema = df.schema
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``limit`` bytes of ``column``.

    A single longer text stays whole: it forms a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets into them (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Ids up to this many are broadcast (24 MB as a hashed relation); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast a checked number of narrow rows; beyond that leave the join to a shuffle."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release_memory() -> None:
    """Give freed memory back to the system: Python workers and the driver live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches_of_texts(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def map_arrow(df: DataFrame, kernel: Kernel, schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS unless the session says otherwise; a task's memory is released at its end."""
    batches_of_texts(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def with_columns_renamed_free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever case rules hold."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_where(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``key``, whatever other columns the two sides have in common."""
    own = with_columns_renamed_free(df, f"_{key}_key")
    side = small(keys.select(F.col(key).alias(own)).distinct())
    return df.join(side, df[key] == side[own], how)
