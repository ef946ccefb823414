"""The facade: a store folder, a configuration, and the verbs over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hash_embed
from .operators import attention, code_index, cycle, dml, folds, layers, scan, stats
from .operators import recall as recalls
from .operators.graph import written
from .schema import L1, L2, Config, MemoryState
from .sources import datasets, store


class MemoryEngine:
    """Every writing verb takes ``now`` and commits a new version; reading verbs return DataFrames."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), embedding=None, provider=None):
        self.spark, self.root, self.config, self.provider = spark, root, config, provider
        self.embedding = embedding or (lambda c: hash_embed(c, config.dim))

    @property
    def state(self) -> MemoryState:
        return store.load(self.spark, self.root)

    def _commit(self, state: MemoryState) -> int:
        return store.commit(state, self.root)

    def _workspace(self, workspace: str) -> str:
        return workspace or self.config.workspace

    def remember(self, content: str, now: float, layer: str = L2, type: str = "fact", summary: str = "", source: str = "", tags=(), workspace: str = "", judge=None) -> DataFrame:
        """Gate, route and store one memory; returns the gate's row."""
        ws, state = self._workspace(workspace), self.state
        one = self.spark.createDataFrame([(content, layer, type, summary, source, list(tags), ws)], "content string, layer string, type string, summary string, source string, tags array<string>, workspace string")
        one = one.withColumn("id", layers.derived_id("remember", F.col("workspace"), F.col("layer"), F.col("content"), F.lit(str(now)))).withColumn("seq", F.lit(0))
        gated = written(attention.gate(one, state.memories, now, self.config, judge), "gated")
        for rows in layers.route(gated.where("action <> 'drop'"), now, self.embedding).values():
            state = dml.put_memories(state, rows)
        self._commit(state)
        return gated

    def record_event(self, agent: str, action: str, now: float, observation: str = "", outcome: str = "", workspace: str = "") -> None:
        one = self.spark.createDataFrame([(agent, action, observation, outcome, self._workspace(workspace))], "agent string, action string, observation string, outcome string, workspace string")
        one = one.withColumn("id", layers.derived_id("event", F.col("workspace"), F.col("agent"), F.col("action"), F.col("observation"), F.lit(str(now))))
        self._commit(dml.put_memories(self.state, layers.episodes(one, now, self.embedding)))

    def recall(self, query: str, now: float, workspace: str = "", commit: bool = True, **options) -> DataFrame:
        """Hits of one query; ``commit`` counts the access of what is returned."""
        one = self.spark.createDataFrame([("q", query, self._workspace(workspace))], "query_id string, query string, workspace string").withColumn("embedding", self.embedding("query"))
        state = self.state
        hits = written(recalls.recall(state, one, now, self.config, **options), "hits")
        if commit:
            self._commit(state.with_(memories=dml.touch(state.memories, hits.select("id"), now)))
        return hits

    def search_code(self, query: str, now: float, workspace: str = "", top_k: int = 0) -> DataFrame:
        return self.recall(query, now, workspace, False, top_k=top_k, layers=[L2], types=["code_symbol", "code_file"], min_similarity=0.01)

    def index_code(self, path: str, now: float, workspace: str = "", force: bool = False, prune: bool = False) -> DataFrame:
        files = datasets.source_tree(self.spark, path, self._workspace(workspace), self.config.ignore_globs)
        state, report = code_index.index_code(self.state, files, now, self.embedding, self.config, force, prune=prune)
        report = written(report, "report")
        self._commit(state)
        return report

    def link(self, src: str, dst: str, now: float, relation: str = "related_to", weight: float = 1.0) -> None:
        rows = self.spark.createDataFrame([(src, dst, relation, weight)], "src_id string, dst_id string, relation string, weight double")
        self._commit(dml.put_edges(self.state, dml.link(rows, now)))

    def forget(self, memory_id: str) -> None:
        self._commit(dml.delete(self.state, self.spark.createDataFrame([(memory_id,)], "id string")))

    def consolidate(self, now: float, workspace: str = "", classify=None, since: float = 0.0) -> DataFrame:
        state, log = folds.consolidate(self.state, now, self.embedding, self.config, self._workspace(workspace), since, classify)
        self._commit(state)
        return folds.action_counts(log)

    def proceduralize(self, now: float, workspace: str = "", min_size: int = 3, threshold: float = 0.55) -> DataFrame:
        state, details = folds.proceduralize(self.state, now, self.embedding, self.config, self._workspace(workspace), min_size, threshold)
        self._commit(state)
        return details

    def extract_mental_models(self, now: float, workspace: str = "") -> DataFrame | None:
        state, details = cycle.extract_models(self.state, now, self.embedding, self.provider, self.config, self._workspace(workspace))
        self._commit(state)
        return details

    def predict_forward_intents(self, now: float, workspace: str = "") -> DataFrame | None:
        state, details = cycle.predict_intents(self.state, now, self.embedding, self.provider, self.config, self._workspace(workspace))
        self._commit(state)
        return details

    def decay(self, now: float, workspace: str | None = "", dry_run: bool = False, **limits) -> DataFrame:
        state, report = cycle.decay(self.state, now, config=self.config, workspace=None if workspace is None else self._workspace(workspace), dry_run=dry_run, **limits)
        report = written(report, "report")
        if not dry_run:
            self._commit(state)
        return report

    def run_cycle(self, now: float, workspace: str = "") -> dict:
        state, reports = cycle.run_cycle(self.state, now, self.embedding, self.provider, self.config, self._workspace(workspace))
        self._commit(state)
        return reports

    def reembed(self, dim: int, embedding=None) -> None:
        """Recompute every vector at another size."""
        self.config = replace(self.config, dim=dim)
        self.embedding = embedding or (lambda c: hash_embed(c, dim))
        state = self.state
        self._commit(state.with_(memories=dml.reembed(state.memories, self.embedding("content"))))

    def list(self, workspace: str = "", layer: str = "", type: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
        return scan.listing(self.state.memories, self._workspace(workspace), layer, type, limit, offset)

    def stats(self, workspace: str = "") -> DataFrame:
        return stats.stats(self.state, self._workspace(workspace))

    def episodes(self, workspace: str = "", limit: int = 0) -> DataFrame:
        return scan.recent(self.state.memories.where(F.col("layer") == L1), self._workspace(workspace), limit)
