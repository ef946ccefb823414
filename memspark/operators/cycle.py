"""Slow maintenance: mental models, forward intents, decay, and the cycle that runs them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta, scoring, text
from ..schema import ABSTRACTABLE, L1, L5, L6, Config, MemoryState
from . import dml, folds, graph, layers, scan
from .clustering import Clustering

CYCLE_KEY, MARK_KEY = "l5_merge_cycle_count", "l6_watermark"


class LLMProvider(Protocol):
    """What a language model must offer; None where there is none, and steps that need it are skipped."""

    def complete_structured(self, system: str, user: str, schema: dict) -> dict: ...


class FakeProvider:
    """A deterministic double: scripted replies by a word in the request, else a default."""

    def __init__(self, default: dict, scripted: dict[str, dict] | None = None):
        self.default, self.scripted = default, scripted or {}

    def complete_structured(self, system: str, user: str, schema: dict) -> dict:
        return next((v for k, v in self.scripted.items() if k in user), self.default)


@dataclass(frozen=True)
class ModelRouting:
    """A model for each operation; what is not set falls back to ``default``."""

    default: LLMProvider | None = None
    consolidate: LLMProvider | None = None
    proceduralize: LLMProvider | None = None
    attention_gate: LLMProvider | None = None
    l5_mental_model: LLMProvider | None = None
    l6_forward_intent: LLMProvider | None = None

    def get(self, operation: str) -> LLMProvider | None:
        own = getattr(self, operation, None) if operation in self.__dataclass_fields__ else None
        return own if own is not None else self.default


def provider_for(provider: LLMProvider | ModelRouting | None, operation: str) -> LLMProvider | None:
    return provider.get(operation) if isinstance(provider, ModelRouting) else provider


def covered_members(state: MemoryState, workspace: str = "") -> DataFrame:
    """Ids that a live mental model abstracts."""
    models = scan.live(scan.memories(state.memories, workspace, L5)).select(F.col("id").alias("src_id"))
    return graph.current(state.edges).where("relation = 'abstracts'").join(models, "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()


def abstractable(state: MemoryState, workspace: str = "") -> DataFrame:
    """Facts, notes, playbooks and snippets that no live model covers; retired ones count too."""
    test = F.lit(False)
    for layer, kind in ABSTRACTABLE:
        test = test | ((F.col("layer") == layer) & (F.col("type") == kind))
    return scan.memories(state.memories, workspace).where(test).join(covered_members(state, workspace), "id", "left_anti")


def clusters(vectors: DataFrame, threshold: float, min_size: int, key: str = "workspace") -> DataFrame:
    """key, id, component, size of components of cosine similarity with enough members."""
    out = graph.written(graph.similar_components(vectors, threshold, key), "components")
    sizes = out.groupBy(key, "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return out.join(sizes, [key, "component"])


def _summaries(members: DataFrame, provider: LLMProvider, prompt: str) -> DataFrame:
    """members (workspace, component, id, type, content) -> with the model's title and body; groups whose call fails are left out."""
    lines = members.groupBy("workspace", "component").agg(F.sort_array(F.collect_list(F.struct("id", "type", "content"))).alias("ms"))
    lines = lines.withColumn("corpus", F.array_join(F.transform("ms", lambda m: F.concat(F.lit("- ("), m["type"], F.lit(") "), m["content"])), "\n"))

    @F.pandas_udf("title string, body string, ok boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out = []
            for corpus in some:
                try:
                    got = provider.complete_structured(prompt, "Abstract these memories into one mental model:\n" + corpus, {"required": ["title", "model"]})
                except Exception:  # noqa: BLE001 - a failing provider skips its cluster, by contract
                    got = {}
                title, body = got.get("title"), got.get("model")
                out.append((title if isinstance(title, str) and title else "mental model", body if isinstance(body, str) else "", bool(got)))
            yield pd.DataFrame(out, columns=["title", "body", "ok"])

    return lines.withColumn("r", ask("corpus")).where("r.ok").select("workspace", "component", "ms", "r.title", "r.body")


def _store_models(state: MemoryState, found: DataFrame, now: float, embedding, source: str) -> tuple[MemoryState, DataFrame]:
    found = found.withColumn("model_id", layers.derived_id(source, F.col("workspace"), F.col("component"), F.lit(str(now)), F.array_join(F.transform("ms", lambda m: m["id"]), ",")))
    found = graph.written(found, "models")
    merged = F.col("merged_from") if "merged_from" in found.columns else F.lit(None).cast("array<string>")
    content = F.when(F.col("body") != "", F.concat_ws(": ", "title", "body")).otherwise(F.col("title"))
    rows = found.select(F.col("model_id").alias("id"), "workspace", content.alias("content"), F.col("title").alias("summary"), F.to_json(F.struct(F.size("ms").alias("n_members"), merged.alias("merged_from"))).alias("metadata"))
    made = layers.memory_rows(rows, now, embedding, layer=L5, type="mental_model", tags=F.array(F.lit("mental_model")), source=source)
    state = dml.put_memories(state, graph.written(made, "models"))
    links = found.select(F.col("model_id").alias("src_id"), F.lit("abstracts").alias("relation"), F.explode(F.transform("ms", lambda m: m["id"])).alias("dst_id"))
    return dml.put_edges(state, dml.link(links, now)), found.select("model_id", F.size("ms").alias("n_members"))


def extract_models(state: MemoryState, now: float, embedding, provider: LLMProvider | None, config: Config = Config(), workspace: str = "", prompt: str = "Abstract.") -> tuple[MemoryState, DataFrame | None]:
    """(new state, details (model_id, n_members, action)); (state, None) without a provider."""
    if provider is None:
        return state, None
    s2 = config.system2
    cand = graph.written(abstractable(state, workspace).withColumn("embedding", embedding("content")), "abstractable")
    members = clusters(cand.select("workspace", "id", "embedding"), s2.l5_similarity, s2.l5_min_cluster).join(cand.select("id", "type", "content"), "id")
    state, details = _store_models(state, _summaries(members, provider, prompt), now, embedding, "l5_extract")
    details = details.withColumn("action", F.lit("new"))
    if s2.l5_merge_every > 0:
        raw = scan.meta_value(state.meta, CYCLE_KEY).first()["value"]
        count = (int(raw) if raw.isdigit() else 0) + 1
        due = count >= s2.l5_merge_every
        state = dml.put_meta(state, state.spark.createDataFrame([(CYCLE_KEY, "0" if due else str(count))], "key string, value string"))
        if due:
            state, more = merge_models(state, now, embedding, provider, config, workspace, prompt)
            details = details.unionByName(more)
    return state, details


def live_models(state: MemoryState, embedding, workspace: str = "") -> DataFrame:
    """workspace, id, embedding of mental models that are not retired."""
    return scan.live(scan.memories(state.memories, workspace, L5)).select("workspace", "id", embedding("content").alias("embedding"))


def merge_models(state: MemoryState, now: float, embedding, provider: LLMProvider, config: Config = Config(), workspace: str = "", prompt: str = "Abstract.", clustering: Clustering | None = None) -> tuple[MemoryState, DataFrame]:
    """Replace similar live models by one over all their members. ``clustering``: that of ``live_models``, advanced
    since the last merge, so that only changed models are compared; else everything is clustered."""
    if clustering is None:
        groups = clusters(live_models(state, embedding, workspace), config.system2.l5_merge_similarity, 2)
    else:
        sizes = clustering.rows.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
        groups = clustering.rows.select("workspace", "id", "component").join(sizes, "component")
    groups = graph.written(groups, "groups")
    held = graph.current(state.edges).where("relation = 'abstracts'").join(groups.select("workspace", "component", F.col("id").alias("src_id")), "src_id").select("workspace", "component", F.col("dst_id").alias("id")).distinct()
    members = held.join(state.memories.select("id", "type", "content"), "id")
    found = _summaries(members, provider, prompt)
    old = groups.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("merged_from"))
    state, details = _store_models(state, found.join(old, "component"), now, embedding, "l5_merge")
    source = state.memories.where("source = 'l5_merge'").select(F.col("id").alias("new_id"), F.from_json("metadata", "merged_from array<string>")["merged_from"].alias("olds"))
    pairs = source.join(details.select(F.col("model_id").alias("new_id")), "new_id", "left_semi").select(F.explode("olds").alias("old_id"), "new_id")
    return graph.retire(state, graph.written(pairs, "retired"), now), details.withColumn("action", F.lit("merged"))


def expired(memories: DataFrame, now: float, workspace: str = "") -> DataFrame:
    """Live intents past their ``valid_to``: a missing one counts as 0, an unreadable one never expires."""
    number = meta.number("metadata", "valid_to")
    until = F.when(~meta.exists("metadata", "valid_to"), F.lit(0.0)).otherwise(number)
    return scan.live(scan.memories(memories, workspace, L6)).where(until.isNotNull() & (F.lit(now) > until))


def intent_window(memories: DataFrame, marks: DataFrame, size: int = 50, workspace: str = "") -> DataFrame:
    """The first ``size`` episodes of each workspace after its mark (strictly), with their place. marks: (workspace, mark)."""
    e = scan.memories(memories, workspace, L1).join(marks, "workspace", "left").where(F.col("created_at") > F.coalesce("mark", F.lit(0.0)))
    w = Window.partitionBy("workspace").orderBy("created_at", "id")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).drop("mark")


def predict_intents(state: MemoryState, now: float, embedding, provider: LLMProvider | None, config: Config = Config(), workspace: str = "", prompt: str = "Predict.") -> tuple[MemoryState, DataFrame | None]:
    """Retire what expired, then ask the provider for next intents of each workspace's window and move its
    mark. Marks are kept by workspace. A provider error ends the pass."""
    if provider is None:
        return state, None
    gone = graph.written(expired(state.memories, now, workspace).select(F.col("id").alias("old_id"), F.lit(None).cast("string").alias("new_id")), "expired")
    state = graph.retire(state, gone, now)
    prefix = MARK_KEY + ":"
    marks = state.meta.where(F.col("key").startswith(prefix)).select(F.expr(f"substring(key, {len(prefix) + 1})").alias("workspace"), F.col("value").try_cast("double").alias("mark"))
    window = graph.written(intent_window(state.memories, marks, config.system2.l6_max_episodes, workspace), "window")
    corpus = window.groupBy("workspace").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("corpus"), F.max("created_at").alias("mark"), F.count(F.lit(1)).alias("seen"))
    horizon = config.system2.l6_horizon_s

    @F.pandas_udf("array<struct<intent: string, confidence: double, horizon_s: double>>")
    def ask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            got = provider.complete_structured(prompt, "Predict likely next intents from these recent episodes:\n" + t, {"required": ["intents"]})
            rows = [x for x in got.get("intents") or [] if isinstance(x, dict) and isinstance(x.get("intent"), str) and x["intent"].strip()]
            number = lambda v, d: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else d
            out.append([{"intent": x["intent"].strip(), "confidence": number(x.get("confidence"), 0.5), "horizon_s": number(x.get("horizon_s"), horizon)} for x in rows])
        return pd.Series(out, dtype=object)

    asked = graph.written(corpus.withColumn("intents", ask("corpus")), "intents")
    each = asked.select("workspace", "mark", F.posexplode("intents").alias("k", "i"))
    details = each.select(layers.derived_id("l6", F.col("workspace"), F.col("mark").cast("string"), F.col("k").cast("string")).alias("id"), "workspace", "i.intent", "i.confidence", "i.horizon_s", (F.lit(now) + F.col("i.horizon_s")).alias("valid_to"))
    rows = layers.memory_rows(details, now, embedding, layer=L6, type="forward_intent", content=F.col("intent"), summary=text.truncate("intent", 80), tags=F.array(F.lit("predicted")), metadata=F.to_json(F.struct("confidence", "horizon_s", "valid_to")), source="l6_predict")
    state = dml.put_memories(state, rows)
    state = dml.put_meta(state, asked.select(F.concat(F.lit(prefix), "workspace").alias("key"), F.col("mark").cast("string").alias("value")))
    return state, details


def decay_candidates(memories: DataFrame, now: float, max_age_s: float = 0.0, floor: float = 0.0, config: Config = Config(), workspace: str | None = "") -> DataFrame:
    """Episodes that are old and whose recency is worth less than the floor; 0 means the default.
    ``workspace=None`` sweeps all workspaces."""
    w = config.activation
    age = F.lit(now) - F.col("last_access_at")
    value = w.recency * scoring.recency("last_access_at", w.half_life_s, now)
    return scan.memories(memories, workspace or "", L1).where((age >= (max_age_s or 30 * 24 * 3600.0)) & (value < (floor or 0.05)))


def decay(state: MemoryState, now: float, max_age_s: float = 0.0, floor: float = 0.0, config: Config = Config(), workspace: str | None = "", dry_run: bool = False) -> tuple[MemoryState, DataFrame]:
    """(new state, one-row report: examined, forgotten, forgotten_ids)."""
    gone = graph.written(decay_candidates(state.memories, now, max_age_s, floor, config, workspace).select("id"), "decayed")
    seen = scan.memories(state.memories, workspace or "", L1).agg(F.count(F.lit(1)).alias("examined"))
    report = seen.crossJoin(gone.agg(F.count(F.lit(1)).alias("forgotten"), F.sort_array(F.collect_list("id")).alias("forgotten_ids")))  # one row each
    return (state if dry_run else dml.delete(state, gone)), report


def run_cycle(state: MemoryState, now: float, embedding, provider: LLMProvider | ModelRouting | None = None, config: Config = Config(), workspace: str = "") -> tuple[MemoryState, dict[str, DataFrame | None]]:
    """Consolidate, proceduralize, then models and intents where there are enough episodes, then decay."""
    reports: dict[str, DataFrame | None] = {}
    state, reports["consolidate"] = folds.consolidate(state, now, embedding, config, workspace)
    state, reports["proceduralize"] = folds.proceduralize(state, now, embedding, config, workspace)
    if scan.memories(state.memories, workspace, L1).limit(config.system2.min_episodes).count() >= config.system2.min_episodes:
        state, reports["models"] = extract_models(state, now, embedding, provider_for(provider, "l5_mental_model"), config, workspace)
        state, reports["intents"] = predict_intents(state, now, embedding, provider_for(provider, "l6_forward_intent"), config, workspace)
    state, reports["decay"] = decay(state, now, config=config, workspace=workspace)
    return state, reports


def reply_json(reply: str) -> dict:
    """The JSON object inside a model's reply, fenced or not."""
    a, b = reply.find("{"), reply.rfind("}")
    return json.loads(reply[a : b + 1]) if 0 <= a < b else {}
