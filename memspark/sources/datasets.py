"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree

BENCHMARK = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>, answer_session_ids array<string>"
)


def json_array(spark: SparkSession, path: str, schema: str = BENCHMARK) -> DataFrame:
    """One JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A relational store's table."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def haystack_turns(questions: DataFrame) -> DataFrame:
    """A row per turn, sessions in order of date: question_id, session_id, date, turn_idx, role, content, has_answer."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    s = questions.select("question_id", F.posexplode(zipped).alias("at", "s"))
    t = s.select("question_id", F.col("s.sid").alias("session_id"), F.col("s.date").alias("date"), "at", F.posexplode("s.turns").alias("turn_idx", "t"))
    return t.select("question_id", "session_id", "date", "at", "turn_idx", "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer")).orderBy("question_id", "date", "at", "turn_idx").drop("at")


def with_sidecar(hits: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Recall results with the metadata kept beside the store."""
    return hits.join(sidecar, "id", "left")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str) -> str:
    """A small report (aggregates only) as a Markdown table."""
    rows = df.limit(1000).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows) + "\n"


def source_tree(spark: SparkSession, root: str, workspace: str, ignore_globs=()) -> DataFrame:
    """Files below a folder: workspace, path (relative), content."""
    spark.dataSource.register(tree.SourceTree)
    files = spark.read.format("source_tree").option("ignore", ",".join(ignore_globs)).load(root)
    return files.select(F.lit(workspace).alias("workspace"), "path", "content")
