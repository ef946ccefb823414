"""The test tables seen as memories, edges, vectors and files, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import L1, L2, MemoryState

#: The time at which time-dependent queries run: 2024-02-01 00:00 UTC.
NOW = 1706745600.0
OUTCOMES = {"purchase": "success", "signup": "ok", "view": "done", "error": "failure", "click": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6").cast("double")


def _ws(c: str) -> Column:
    return F.concat(F.lit("ws"), (F.col(c) % 4).cast("string"))


def facts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit(L2).alias("layer"), F.lit("fact").alias("type"), F.coalesce("text", F.lit("")).alias("content"), text.truncate("text", 80).alias("summary"),
        "source", _ws("doc_id").alias("workspace"), (F.lit(1704067200.0) + F.col("doc_id")).alias("created_at"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"), "doc_id",
    )


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])[F.col("event_type")]
    e = e.select(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"), _ws("user_id").alias("workspace"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("agent"), F.col("event_type").alias("action"), F.col("props").alias("observation"), outcome.alias("outcome"), epoch("ts").alias("created_at"), (F.col("event_id") % 7).cast("int").alias("access_count"), "event_id", "user_id", "ts")
    return e.withColumn("content", text.episode_content("agent", "action", "observation", "outcome")).withColumn("layer", F.lit(L1)).withColumn("type", F.lit("event")).withColumn("last_access_at", F.col("created_at"))


def edges(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("e-"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("src_id"), F.col("o_orderpriority").alias("relation"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("dst_id"),
        F.col("o_totalprice").alias("weight"), epoch("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", epoch("o_orderdate") + 86400.0).alias("valid_to"), F.lit("{}").alias("metadata"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "embedding", "label", _ws("vec_id").alias("workspace"))


def state(spark, sf_dir, embedding) -> MemoryState:
    """Documents as facts and events as episodes, embedded."""
    from ..operators import graph, layers

    d = layers.memory_rows(facts(spark, sf_dir).drop("doc_id"), NOW)
    e = layers.episodes(events(spark, sf_dir).select("id", "workspace", "agent", "action", "observation", "outcome", "created_at", "last_access_at", "access_count"), NOW)
    both = d.unionByName(e)
    return MemoryState.empty(spark, memories=graph.written(both.withColumn("embedding", embedding("content")), "memories"))  # each row is embedded once


SQL = {
    "facts": """facts AS (SELECT 'doc-' || doc_id AS id, 'L2_semantic' AS layer, 'fact' AS type, coalesce(text, '') AS content, substr(text, 1, 80) AS summary, source, 'ws' || (doc_id % 4) AS workspace,
        1704067200.0::DOUBLE + doc_id AS created_at, md5(coalesce(text, '')) AS content_hash, doc_id FROM documents)""",
    "episodes": """episodes AS (SELECT *, 'L1_episodic' AS layer, 'event' AS type, created_at AS last_access_at, concat_ws(' | ', 'agent=' || agent, 'action=' || action, CASE WHEN observation <> '' THEN 'observation=' || observation END,
        CASE WHEN outcome <> '' THEN 'outcome=' || outcome END) AS content FROM (SELECT 'ev-' || event_id AS id, 'ws' || (user_id % 4) AS workspace, 'user_' || user_id AS agent, event_type AS action, props AS observation,
        CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'ok' WHEN 'view' THEN 'done' WHEN 'error' THEN 'failure' WHEN 'click' THEN '' END AS outcome, epoch(ts) AS created_at, (event_id % 7)::INT AS access_count, event_id, user_id, ts FROM events))""",
    "edges": """edges AS (SELECT 'e-' || o_orderkey AS id, 'c-' || o_custkey AS src_id, o_orderpriority AS relation, 'o-' || o_orderkey AS dst_id, o_totalprice AS weight, epoch(o_orderdate) AS valid_from,
        CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) + 86400.0 END AS valid_to FROM orders)""",
    "vectors": "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, 'ws' || (vec_id % 4) AS workspace FROM embeddings)",
    "tokens": r"""tokens AS (SELECT id, list_transform(flatten(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+|[.,;:()\[\]{}]'),
        lambda r: CASE WHEN len(regexp_extract_all(r, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) > 0 THEN regexp_extract_all(regexp_replace(r, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') ELSE [r] END)), lambda t: lower(t)) AS t FROM facts)""",
}


def sql(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[v] for v in views) + "\n" + body
