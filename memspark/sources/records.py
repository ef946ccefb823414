"""Records of unsure shape: JSON as VARIANT, and a channel for those that don't fit.

``parsed`` turns JSON text into VARIANT without failing; ``shaped`` casts its fields to a schema and names the first problem of each
record; ``split`` gives fitting records and bad ones (value, problem), so nothing is lost silently. All is done by
built-in expressions in one pass; a JSON-lines file is split over tasks, one that is a single array is one row until its
elements are exploded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .datasets import BENCHMARK

NOT_JSON, NOT_OBJECT = "not JSON", "not an object"


def json_values(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """value, v: a row per line that isn't blank, or per element of files that are one JSON array each."""
    if not array:
        return parsed(spark.read.text(path).where(F.trim("value") != ""))
    files = parsed(spark.read.text(path, wholetext=True).where(F.trim("value") != ""))
    parts = files.withColumn("parts", F.try_variant_get("v", "$", "array<variant>"))
    each = parts.where("parts IS NOT NULL").select(F.explode("parts").alias("v")).select(F.to_json("v").alias("value"), "v")
    return each.unionAll(parts.where("parts IS NULL").select("value", F.lit(None).cast("variant").alias("v")))


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.col(value).alias("value"), F.try_parse_json(F.col(value)).alias("v"))


def shaped(rows: DataFrame, schema: str, required: Iterable[str] = ()) -> DataFrame:
    """rows (value, v) -> value, the schema's fields, problem (null if the record fits). Fields that are absent or null are null;
    a value that can't be cast is a problem, and so is the absence of a ``required`` one."""
    fields, required = StructType.fromDDL(schema).fields, set(required)
    problem: Column = F.when(F.col("v").isNull(), NOT_JSON).when(~F.schema_of_variant("v").startswith("OBJECT"), NOT_OBJECT)
    for f in fields:
        raw = F.try_variant_get("v", f"$['{f.name}']", "variant")
        absent = raw.isNull() | F.coalesce(F.is_variant_null(raw), F.lit(False))
        if f.name in required:
            problem = problem.when(absent, f"{f.name} is missing")
        problem = problem.when(~absent & F.try_variant_get("v", f"$['{f.name}']", f.dataType.simpleString()).isNull(), f"{f.name} does not fit")
    return rows.select("value", *[F.try_variant_get("v", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields], problem.alias("problem"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fitting records without value and problem, and bad ones (value, problem)."""
    return rows.where("problem IS NULL").drop("value", "problem"), rows.where("problem IS NOT NULL").select("value", "problem")


def read_questions(spark: SparkSession, path: str, array: bool = True) -> tuple[DataFrame, DataFrame]:
    """A retrieval benchmark's questions, and bad records; sessions, their ids and dates must be as many."""
    rows = shaped(json_values(spark, path, array), BENCHMARK, ("question_id", "haystack_sessions", "haystack_session_ids"))
    odd = F.size("haystack_sessions") != F.size("haystack_session_ids")
    odd = odd | (F.col("haystack_dates").isNotNull() & (F.size("haystack_sessions") != F.size("haystack_dates")))
    return split(rows.withColumn("problem", F.coalesce("problem", F.when(odd, "sessions and ids differ in number"))))
