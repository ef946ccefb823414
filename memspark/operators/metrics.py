"""Retrieval metrics over arrays of recalled and gold ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recall_all(recalled, gold, k: int) -> Column:
    """1 if every gold id is in the first k, 0 if not or without gold."""
    r, g = _col(recalled), _col(gold)
    return F.when((F.size(g) > 0) & (F.size(F.array_except(g, F.slice(r, 1, k))) == 0), 1.0).otherwise(0.0)


def recall_any(recalled, gold, k: int) -> Column:
    return F.when(F.coalesce(F.arrays_overlap(_col(gold), F.slice(_col(recalled), 1, k)), F.lit(False)), 1.0).otherwise(0.0)


def dcg(relevances: Column) -> Column:
    """First gain, then gains over log2 of their place (so places 1 and 2 count fully)."""
    return F.aggregate(F.transform(relevances, lambda x, i: F.when(i == 0, x).otherwise(x / F.log2(F.greatest(i + 1, F.lit(2)).cast("double")))), F.lit(0.0), lambda s, x: s + x)


def ndcg(recalled, gold, k: int) -> Column:
    g = _col(gold)
    gains = F.transform(F.slice(_col(recalled), 1, k), lambda x: F.when(F.array_contains(g, x), 1.0).otherwise(0.0))
    ideal = F.array_repeat(F.lit(1.0), F.least(F.size(F.array_distinct(g)), F.lit(k)))
    return F.when(F.size(g) > 0, dcg(gains) / dcg(ideal)).otherwise(0.0)


def sessions(recalled) -> Column:
    """Sessions of recalled turns (``session_turn``), each at its first place."""
    return F.array_distinct(F.transform(_col(recalled), lambda x: F.regexp_extract(x, r"^(.*)_[^_]*$", 1)))


def strip_turns(recalled, gold_turns, k: int) -> Column:
    """Session recall with the list widened until k different sessions are in it."""
    return F.slice(sessions(recalled), 1, k)


def metric_row(df: DataFrame, turn_ks=(5, 10, 50), session_ks=(5, 10)) -> DataFrame:
    """df (query_id, recalled, gold, gold_sessions) -> one column per metric."""
    s = sessions("recalled")
    out = [F.col("query_id")]
    for k in turn_ks:
        out += [recall_all("recalled", "gold", k).alias(f"turn_recall_all_{k}"), ndcg("recalled", "gold", k).alias(f"turn_ndcg_any_{k}")]
    for k in session_ks:
        out += [recall_all(s, "gold_sessions", k).alias(f"session_recall_all_{k}"), ndcg(s, "gold_sessions", k).alias(f"session_ndcg_any_{k}")]
    return df.select(*out)


def mean_metrics(rows: DataFrame, skip_abstention: bool = True) -> DataFrame:
    """Means over questions, rounded to 4; abstention questions (``_abs``) are left out."""
    if skip_abstention:
        rows = rows.where(~F.col("query_id").contains("_abs"))
    return rows.agg(*[F.round(F.avg(c), 4).alias(c) for c in rows.columns if c != "query_id"])


def qa_accuracy(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (question_id, question_type, correct) -> (accuracy by type, one row of task-averaged, overall and abstention)."""
    hit = F.col("correct").cast("double")
    by_type = answers.groupBy("question_type").agg(F.round(F.avg(hit), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    task = answers.groupBy("question_type").agg(F.avg(hit).alias("a")).agg(F.round(F.avg("a"), 4).alias("task_averaged"))
    rest = answers.agg(F.round(F.avg(hit), 4).alias("overall"), F.round(F.avg(F.when(F.col("question_id").contains("_abs"), hit)), 4).alias("abstention"))
    return by_type, task.crossJoin(rest)  # one row each


def gold_turns(turns: DataFrame) -> DataFrame:
    """turns (question_id, session_id, turn_idx, has_answer) -> gold ids of each question."""
    hit = turns.where(F.coalesce("has_answer", F.lit(False)))
    return hit.groupBy("question_id").agg(F.sort_array(F.collect_set(F.concat_ws("_", "session_id", F.col("turn_idx").cast("string")))).alias("gold"), F.sort_array(F.collect_set("session_id")).alias("gold_sessions"))


def answerable(hits: DataFrame, floor: float = 0.05, top: int = 10) -> DataFrame:
    """query_id, context (the best contents) and abstain: an ``_abs`` question whose best score is under the floor."""
    best = hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.max("score").alias("best"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("context"))
    return best.withColumn("abstain", F.col("query_id").cast("string").contains("_abs") & (F.col("best") < floor))
