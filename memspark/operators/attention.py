"""The attention gate: what is worth remembering."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import L0, L1, Config


def duplicates(events: DataFrame, window_s: float, key: str = "workspace") -> DataFrame:
    """Rows whose content was already seen in the last ``window_s`` seconds."""
    w = Window.partitionBy(key, "content").orderBy("created_at", "id")
    before = F.lag("created_at").over(w)
    return events.withColumn("before", before).where(F.col("created_at") - F.col("before") <= window_s).drop("before")


def gate(requests: DataFrame, memories: DataFrame, now: float, config: Config = Config(), judge: Callable[[list[str]], list[tuple[str, str]]] | None = None) -> DataFrame:
    """requests (id, content, layer, workspace) -> with action (pass, drop, rewrite), reason and content.

    Working notes pass; all-noise content drops; content that an episode of the workspace had within the
    window drops; then an optional judge (texts -> (action, text)) decides; the rest passes."""
    recent = memories.where((F.col("layer") == L1) & (F.col("created_at") >= now - config.dedup_window_s)).select("workspace", F.col("content").alias("_c")).distinct().withColumn("_dup", F.lit(True))
    r = requests.withColumn("_c", F.trim("content")).join(recent, ["workspace", "_c"], "left")
    reason = F.when(F.col("layer") == L0, "working memory never gated").when(text.is_noise("content", config.noise_words), "noise").when(F.col("_dup"), "duplicate")
    action = F.when(F.col("layer") == L0, "pass").when(text.is_noise("content", config.noise_words) | F.col("_dup"), "drop")
    r = r.withColumn("action", action).withColumn("reason", reason).drop("_c", "_dup")
    if judge is None:
        return r.withColumn("action", F.coalesce("action", F.lit("pass"))).withColumn("reason", F.coalesce("reason", F.lit("")))

    @F.pandas_udf("action string, text string")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge(texts.tolist()), columns=["action", "text"])

    r = r.withColumn("_j", F.when(F.col("action").isNull(), ask("content")))
    rewritten = F.col("action").isNull() & (F.col("_j.action") == "rewrite") & (F.col("_j.text") != "")
    return r.withColumn("content", F.when(rewritten, F.col("_j.text")).otherwise(F.col("content"))).withColumn("reason", F.coalesce("reason", F.when(F.col("action").isNull(), "judge"))).withColumn("action", F.coalesce("action", "_j.action", F.lit("pass"))).drop("_j")
