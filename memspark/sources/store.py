"""Snapshots: a state is written as Parquet under a new version; a marker file in it, created last and
never overwritten, commits it.

Readers take the highest version with a marker and so see whole versions only, at every moment; a failed
write leaves a folder without one, which the next writer replaces. Paths go through Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..schema import MemoryState


#: The file that commits a version.
MARKER = "_COMMITTED"


class IndexLocked(RuntimeError):
    """Another writer holds the store."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Seconds after which a lock is taken to be left by a writer that died.
LEASE = 6 * 3600


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, in order."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for entry in fs.listStatus(p):
        name = entry.getPath().getName()
        if name.startswith("v=") and fs.exists(_fs(spark, f"{root}/{name}/{MARKER}")[1]):
            found.append(int(name[2:]))
    return sorted(found)


def current_version(spark: SparkSession, root: str) -> int | None:
    return max(_versions(spark, root), default=None)


@contextlib.contextmanager
def writer(spark: SparkSession, root: str, lease: float = LEASE) -> Iterator[None]:
    """One writer at a time; a second fails at once, unless the lock is older than its lease."""
    fs, p = _fs(spark, f"{root}/LOCK")
    if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > lease:
        fs.delete(p, False)
    try:
        fs.create(p, False).close()
    except Exception as e:
        raise IndexLocked(root) from e
    try:
        yield
    finally:
        fs.delete(p, False)


def commit(state: MemoryState, root: str) -> int:
    """Write every table of the state as the next version and make it current."""
    spark = state.spark
    with writer(spark, root):
        version = (current_version(spark, root) or 0) + 1
        for name in MemoryState.SCHEMAS:
            df: DataFrame = getattr(state, name)
            out = df.write.mode("overwrite")
            if name == "memories":
                out = out.partitionBy("workspace", "layer")
            out.parquet(f"{root}/v={version}/{name}")
        fs, marker = _fs(spark, f"{root}/v={version}/{MARKER}")
        fs.create(marker, False).close()  # fails where another writer was first
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> MemoryState:
    """The current (or a given) version; an empty state where nothing is committed."""
    version = version or current_version(spark, root)
    if version is None:
        return MemoryState.empty(spark)
    tables = {}
    for name, schema in MemoryState.SCHEMAS.items():
        df = spark.read.schema(schema).parquet(f"{root}/v={version}/{name}")
        tables[name] = df.select(*[c.split()[0] for c in schema.split(", ")])
    return MemoryState(**tables)
