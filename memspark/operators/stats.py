"""Store statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import MemoryState
from . import scan


def counts(memories: DataFrame, workspace: str = "") -> DataFrame:
    """Rows by layer and type."""
    return scan.where_all(memories, workspace=workspace).groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"))


def rollup(memories: DataFrame, workspace: str = "") -> DataFrame:
    """Counts by layer, by type and in all, by grouping sets over the small table of pairs."""
    c = counts(memories, workspace)
    return c.groupingSets([["layer"], ["type"], []], "layer", "type").agg(F.sum("n").alias("n"))


def table_counts(state: MemoryState) -> DataFrame:
    """Edges (closed ones too) and code symbols of the whole store."""
    e = state.edges.agg(F.count(F.lit(1)).alias("edges"))
    return e.crossJoin(state.symbols.agg(F.count(F.lit(1)).alias("code_symbols")))  # one row each


def average_tokens(memories: DataFrame, workspace: str = "") -> DataFrame:
    m = scan.where_all(memories, workspace=workspace)
    return m.agg(F.coalesce(F.sum(F.size(text.tokenize("content"))) / F.count(F.lit(1)), F.lit(0.0)).alias("avg_tokens"))


def workspaces(memories: DataFrame) -> DataFrame:
    return memories.select("workspace").distinct().orderBy("workspace")


def stats(state: MemoryState, workspace: str = "") -> DataFrame:
    """One row: total_memories, by_layer, by_type, edges, code_symbols, workspaces, avg_tokens_per_memory."""
    r = rollup(state.memories, workspace)
    as_map = lambda k: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, "n")))))
    one = r.agg(F.coalesce(F.max(F.when(F.col("layer").isNull() & F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("total_memories"), as_map("layer").alias("by_layer"), as_map("type").alias("by_type"))
    ws = state.memories.agg(F.sort_array(F.collect_set("workspace")).alias("workspaces"))
    avg = average_tokens(state.memories, workspace).withColumnRenamed("avg_tokens", "avg_tokens_per_memory")
    return one.crossJoin(table_counts(state)).crossJoin(ws).crossJoin(avg)  # one row each


def request_metrics(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (path, status, ms) -> (requests and errors of each path under /api/, one row: mean recall latency)."""
    api = log.where(F.col("path").startswith("/api/"))
    ends = api.groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("status").between(200, 299)).alias("errors"))
    return ends, api.agg(F.coalesce(F.avg(F.when(F.col("path") == "/api/recall", F.col("ms"))), F.lit(0.0)).alias("recall_avg_ms"))
