"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Counted as part of the llm subpackage. Quality rules drop what the learned list rejects; of each class
of near-duplicates the document of least id stays; documents that overlap a benchmark item go; the
curriculum repeats or leaves out documents to meet source targets; the rest is tokenised into chunk
files and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import decontam, mixing, neardup, quality, tokenbin
from memspark.llm.common import drop_path, fresh_path, prepare
from memspark.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.query(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("token output", token_output)]

#: Learned rules, sampling by hash tables and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
