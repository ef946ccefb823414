"""Helpers shared by the training-data operators.

Conventions: operators address columns by name, return narrow frames, and never rely on extra
columns, so that clashing names cannot disturb them. A null text counts as an empty one and a
null id stays null.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; with texts of some KB a batch is a few MB.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (long texts must not pile up in a Python worker) and a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, also set for ``checkpoint()``."""
    where = shared.shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Paths of the innermost ``scratch`` block; None outside of any.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are dropped at its end, but for those written with ``keep``."""
    token = _scratch.set([])
    try:
        yield
    finally:
        paths = _scratch.get() or []
        _scratch.reset(token)
        for path in paths:
            drop_path(spark, path)


def written(df: DataFrame, kind: str, keep: bool = False, **options) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    if not keep and _scratch.get() is not None:
        _scratch.get().append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: The operator that last ran in this Python worker, and what forgets its memo.
_last: tuple[str, Callable[[], object]] | None = None


def takes_over(operator: str, forget: Callable[[], object] = lambda: None) -> None:
    """Called by an operator's tasks. Python workers outlive tasks and serve one operator after another: when the next one
    begins, the last one's memo goes, and what its batches left with the allocators returns to the system."""
    global _last
    before, _last = _last, (operator, forget)
    if before and before[0] != operator:
        before[1]()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
            trim(0)


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(mod: int, col: str = "doc_id") -> Column:
    """crc32(id as text) mod ``mod``."""
    return F.crc32(id_text(col).cast("binary")) % mod


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
