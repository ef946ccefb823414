"""Row constructors of the memory layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import content_hash
from ..schema import L0, L1, L2, L3, MEMORY

COLUMNS = [c.split()[0] for c in MEMORY.split(", ")]


def derived_id(*parts) -> Column:
    """A replayable id from what a row is made of."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256), 1, 32)


def memory_rows(df: DataFrame, now: float, embedding=None, **given) -> DataFrame:
    """``df`` with every memory column: from ``given``, from ``df``, or a default."""
    empty = F.array().cast("array<string>")
    defaults = {
        "content": F.lit(""), "summary": F.lit(""), "tags": empty, "metadata": F.lit("{}"), "source": F.lit(""), "workspace": F.lit("default"), "created_at": F.lit(now), "updated_at": F.lit(now),
        "last_access_at": F.lit(now), "access_count": F.lit(0), "activation": F.lit(0.0), "content_hash": F.lit(""), "embedding": F.lit(None).cast("array<float>"),
    }
    kinds = dict(c.split(" ", 1) for c in MEMORY.split(", "))

    def value(c):
        if c in given:
            g = given[c]
            v = g if isinstance(g, Column) else F.lit(g)
            return F.coalesce(v, defaults[c]) if c in defaults and c != "embedding" else v
        if c in df.columns:
            return F.coalesce(F.col(c), defaults[c]) if c in defaults and c != "embedding" else F.col(c)
        return defaults[c]

    out = df.select(*[value(c).cast(kinds[c]).alias(c) for c in COLUMNS])
    return out.withColumn("embedding", embedding("content")) if embedding else out


def episodes(df: DataFrame, now: float, embedding=None) -> DataFrame:
    """(id, agent, action, observation, outcome[, metadata keys]) -> L1 events; they carry no hash."""
    full = F.struct(
        F.col("agent"), F.col("action"), F.when(F.col("observation") != "", F.col("observation")).alias("observation"), F.when(F.col("outcome") != "", F.col("outcome")).alias("outcome"),
        *[F.col(c) for c in df.columns if c in ("session_id", "date", "turn_idx", "doc_id", "has_answer")],
    )
    return memory_rows(
        df, now, embedding, layer=L1, type="event", content=text.episode_content("agent", "action", "observation", "outcome"), summary=F.concat_ws(": ", "agent", "action"),
        metadata=F.to_json(full), source=F.col("agent"),
    )


def facts(df: DataFrame, now: float, embedding=None) -> DataFrame:
    """(id, content[, summary...]) -> L2 facts."""
    summary = F.col("summary") if "summary" in df.columns else F.lit("")
    short = F.when(F.coalesce(summary, F.lit("")) == "", text.truncate("content", 80)).otherwise(summary)
    return memory_rows(df, now, embedding, layer=L2, type="fact", summary=short, content_hash=content_hash("content"))


def code_files(df: DataFrame, now: float, embedding=None) -> DataFrame:
    """(id, path, file_summary, language) -> L2 code files."""
    return memory_rows(
        df, now, embedding, layer=L2, type="code_file", content=F.col("file_summary"), summary=text.truncate("file_summary", 120), tags=F.array(F.lit("code"), "language"), source=F.col("path"),
        metadata=F.to_json(F.struct(F.col("path").alias("file_path"), "language")), content_hash=content_hash("file_summary"),
    )


def playbooks(df: DataFrame, now: float, embedding=None) -> DataFrame:
    """(id, name, steps[, preconditions, expected_outcome, tags]) -> L3 playbooks."""
    none = F.array().cast("array<string>")
    pre = F.coalesce(F.col("preconditions"), none) if "preconditions" in df.columns else none
    expected = F.col("expected_outcome") if "expected_outcome" in df.columns else F.lit("")
    tags = F.coalesce(F.col("tags"), none) if "tags" in df.columns else none
    meta = F.to_json(F.struct("name", pre.alias("preconditions"), "steps", expected.alias("expected_outcome")))
    content = text.playbook_content("name", "steps")
    return memory_rows(df, now, embedding, layer=L3, type="playbook", content=content, summary=F.col("name"), metadata=meta, tags=F.concat(tags, F.array(F.lit("playbook"))), source="proceduralize", content_hash=content_hash(content))


def snippets(df: DataFrame, now: float, embedding=None) -> DataFrame:
    """(id, title, code, code_language[, tags]) -> L3 snippets; they carry no hash."""
    none = F.array().cast("array<string>")
    tags = F.coalesce(F.col("tags"), none) if "tags" in df.columns else none
    return memory_rows(
        df, now, embedding, layer=L3, type="snippet", content=text.snippet_content("title", "code_language", "code"), summary=F.col("title"),
        metadata=F.to_json(F.struct("title", F.col("code_language").alias("language"))), tags=F.concat(tags, F.array(F.lit("snippet"), F.col("code_language"))),
    )


def working(df: DataFrame, now: float, capacity: int = 64, order: str = "seq") -> DataFrame:
    """The last ``capacity`` notes of each workspace."""
    w = Window.partitionBy("workspace").orderBy(F.desc(order), F.desc("id"))
    last = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")
    return memory_rows(last, now, layer=L0, type="note", summary=text.truncate("content", 80))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> event fields; one event for each turn."""
    return conversations.select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("agent"), F.col("text").alias("action"), F.lit("").alias("observation"), F.lit("").alias("outcome"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_idx"), F.concat_ws("_", "conv_id", "turn").alias("doc_id"))


def retained(conversations: DataFrame) -> DataFrame:
    """``Q: ... A: ...`` of the latest user and assistant turns of each conversation that has both."""
    last = conversations.groupBy("conv_id").agg(
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"),
        F.max(F.col("role") == "user").alias("has_q"), F.max(F.col("role") == "assistant").alias("has_a"),
    )
    return last.where("has_q and has_a").select("conv_id", F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "a").alias("content"))


def route(requests: DataFrame, now: float, embedding=None) -> dict[str, DataFrame]:
    """Remember requests (id, seq, content, layer, type, summary, source, tags, workspace) by target:
    working notes, episodes, snippets, playbooks; everything else becomes a fact whatever it asked for."""
    r = requests.withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("source", F.coalesce("source", F.lit("")))
    brief = F.when(F.col("summary") != "", F.col("summary")).otherwise(text.truncate("content", 80))
    snippet = (F.col("layer") == L3) & (F.col("type") == "snippet")
    playbook = (F.col("layer") == L3) & (F.col("type") != "snippet")
    rest = ~F.col("layer").isin(L0, L1, L3)
    keep = ["id", "tags", "workspace"]
    events = r.where(F.col("layer") == L1).select(*keep, F.when(F.col("source") != "", F.col("source")).otherwise("user").alias("agent"), brief.alias("action"), F.col("content").alias("observation"), F.lit("").alias("outcome"))
    codes = r.where(snippet).select(*keep, F.when(F.col("summary") != "", F.col("summary")).otherwise("snippet").alias("title"), F.col("content").alias("code"), F.lit("python").alias("code_language"))
    plays = r.where(playbook).select(*keep, brief.alias("name"), text.split_lines("content").alias("steps"))
    return {
        "working": working(r.where(F.col("layer") == L0), now),
        "episodes": episodes(events, now, embedding),
        "snippets": snippets(codes, now, embedding),
        "playbooks": playbooks(plays, now, embedding),
        "facts": facts(r.where(rest).drop("layer", "type"), now, embedding),
    }
