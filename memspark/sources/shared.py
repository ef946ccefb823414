"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


#: Rows in one Arrow batch: with texts of some KB a batch is a few MB.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Long texts must not pile up in a Python worker or in the buffers that feed it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local master without one gets a temporary folder; on a
    cluster that would be a different folder on each machine, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "memspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
