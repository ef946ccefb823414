"""Data model: layers, types, row schemas, configuration and the immutable state that operators map.

A ``MemoryState`` is a set of DataFrames. Operators never mutate: they take a state and parameters
(``now`` among them) and return a new state and a report, so retries and replays agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

# Layer and type names.
L0, L1, L2, L3, L4, L5, L6 = "L0_working", "L1_episodic", "L2_semantic", "L3_procedural", "L4_associative", "L5_mental", "L6_predictive"
LAYERS = (L0, L1, L2, L3, L4, L5, L6)
TYPES = ("note", "event", "fact", "code_file", "code_symbol", "playbook", "snippet", "mental_model", "forward_intent")
ABSTRACTABLE = ((L2, "fact"), (L2, "note"), (L3, "playbook"), (L3, "snippet"))

MEMORY = (
    "id string, layer string, type string, content string, summary string, tags array<string>, metadata string, source string, workspace string, "
    "created_at double, updated_at double, last_access_at double, access_count int, activation double, content_hash string, embedding array<float>"
)
EDGE = "id string, src_id string, relation string, dst_id string, weight double, valid_from double, valid_to double, metadata string"
SYMBOL = "memory_id string, file_path string, symbol_kind string, qualified_name string, signature string, docstring string, line_start int, line_end int, language string"
REF = "src_symbol string, dst_symbol string, ref_kind string, workspace string, file_path string"
INDEX = "workspace string, file_path string, body_hash string, indexed_at double"
META = "key string, value string"
USER = "username string, password_hash string, workspace string, admin boolean, created_at double"


@dataclass(frozen=True)
class ActivationWeights:
    similarity: float = 1.0
    recency: float = 0.3
    frequency: float = 0.2
    graph: float = 0.15
    type_boost: float = 0.25
    half_life_s: float = 7 * 24 * 3600.0


@dataclass(frozen=True)
class RecallConfig:
    top_k_tier1: int = 8
    top_k_tier2: int = 20
    graph_hops: int = 2
    min_hits: int = 2
    min_coverage: float = 0.5
    enable_tier2: bool = True


@dataclass(frozen=True)
class System2Config:
    interval_s: int = 300
    min_episodes: int = 3
    max_consecutive_errors: int = 10
    l5_similarity: float = 0.65
    l5_min_cluster: int = 3
    l5_merge_similarity: float = 0.80
    l5_merge_every: int = 5
    l6_max_episodes: int = 50
    l6_horizon_s: float = 3 * 24 * 3600.0


@dataclass(frozen=True)
class Config:
    workspace: str = "default"
    dim: int = 256
    activation: ActivationWeights = field(default_factory=ActivationWeights)
    recall: RecallConfig = field(default_factory=RecallConfig)
    system2: System2Config = field(default_factory=System2Config)
    dedup_similarity: float = 0.85
    min_episodes_to_trigger: int = 3
    dedup_window_s: float = 3600.0
    noise_words: tuple[str, ...] = ()
    max_body_lines: int = 40
    ignore_globs: tuple[str, ...] = ("**/.venv/**", "**/node_modules/**", "**/__pycache__/**")
    working_capacity: int = 64

    @classmethod
    def layered(cls, *layers: dict) -> Config:
        """Later layers win, key by key, also inside the nested parts."""
        out = cls()
        for layer in layers:
            changes = {}
            for f in fields(cls):
                if f.name in layer:
                    value, old = layer[f.name], getattr(out, f.name)
                    changes[f.name] = replace(old, **value) if isinstance(value, dict) else tuple(value) if isinstance(old, tuple) else value
            out = replace(out, **changes)
        return out


@dataclass(frozen=True)
class MemoryState:
    memories: DataFrame
    edges: DataFrame
    symbols: DataFrame
    refs: DataFrame
    index_state: DataFrame
    meta: DataFrame
    users: DataFrame

    SCHEMAS = {"memories": MEMORY, "edges": EDGE, "symbols": SYMBOL, "refs": REF, "index_state": INDEX, "meta": META, "users": USER}

    @classmethod
    def empty(cls, spark: SparkSession, **tables: DataFrame) -> MemoryState:
        return cls(**{k: tables.get(k) if tables.get(k) is not None else spark.createDataFrame([], s) for k, s in cls.SCHEMAS.items()})

    def with_(self, **tables: DataFrame) -> MemoryState:
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.memories.sparkSession
