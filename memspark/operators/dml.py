"""Set-based writes: each function maps tables to new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..schema import EDGE, MemoryState


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest row of each key wins (``order`` ranks rows that arrive together); columns in ``keep``
    stay as first written. Old rows are touched only by an anti-join on the keys that arrive."""
    columns = table.columns
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    else:
        rows = rows.dropDuplicates([key])
    fresh = rows.select(*columns)
    if keep:
        old = table.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in keep])
        fresh = fresh.join(old, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in columns])
    return table.join(rows.select(key), key, "left_anti").select(*columns).unionByName(fresh)


def put_memories(state: MemoryState, rows: DataFrame, order: str | None = None) -> MemoryState:
    """Upsert; ``created_at`` of a known id stays."""
    return state.with_(memories=upsert(state.memories, rows, "id", order, ("created_at",)))


def put_edges(state: MemoryState, rows: DataFrame, order: str | None = None) -> MemoryState:
    """Upsert edges whose two ends exist."""
    ids = state.memories.select("id")
    ok = rows.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return state.with_(edges=upsert(state.edges, ok, "id", order))


def put_symbols(state: MemoryState, rows: DataFrame) -> MemoryState:
    return state.with_(symbols=upsert(state.symbols, rows, "memory_id"))


def append_refs(state: MemoryState, rows: DataFrame) -> MemoryState:
    """A bag: duplicates stay."""
    return state.with_(refs=state.refs.unionByName(rows.select(*state.refs.columns)))


def put_meta(state: MemoryState, rows: DataFrame) -> MemoryState:
    return state.with_(meta=upsert(state.meta, rows, "key"))


def put_users(state: MemoryState, rows: DataFrame) -> MemoryState:
    return state.with_(users=upsert(state.users, rows, "username"))


def drop_users(state: MemoryState, names: DataFrame) -> MemoryState:
    return state.with_(users=state.users.join(names.select("username"), "username", "left_anti"))


def delete(state: MemoryState, ids: DataFrame) -> MemoryState:
    """Delete memories with their edges and symbols."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()

    def without(table, column):
        return table.join(gone.withColumnRenamed("id", column), column, "left_anti").select(*table.columns)

    return state.with_(memories=without(state.memories, "id"), edges=without(without(state.edges, "src_id"), "dst_id"), symbols=without(state.symbols, "memory_id"))


def delete_by_source(state: MemoryState, type_: str, sources: DataFrame, workspace: str) -> MemoryState:
    """Delete memories of a type from given sources of a workspace."""
    hit = state.memories.where((F.col("type") == type_) & (F.col("workspace") == workspace)).join(sources.select("source").distinct(), "source", "left_semi")
    return delete(state, hit.select("id"))


def delete_by_symbol(state: MemoryState, names: DataFrame, workspace: str) -> MemoryState:
    """Delete code symbols' memories by qualified name."""
    ids = state.symbols.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select(F.col("memory_id").alias("id"))
    hit = state.memories.where((F.col("type") == "code_symbol") & (F.col("workspace") == workspace)).join(ids, "id", "left_semi")
    return delete(state, hit.select("id"))


def patch_content(state: MemoryState, patches: DataFrame, now: float) -> MemoryState:
    """patches (id, content, embedding): new content; hash and vector change only with a new vector.
    Unknown ids do nothing."""
    p = patches.select("id", F.col("content").alias("_content"), F.col("embedding").alias("_embedding"), content_hash("content").alias("_hash"))
    m = state.memories.join(p, "id", "left")
    hit = F.col("_content").isNotNull()
    vector = F.col("_embedding").isNotNull()
    changed = {"content": F.when(hit, F.col("_content")), "updated_at": F.when(hit, F.lit(now)), "embedding": F.when(vector, F.col("_embedding")), "content_hash": F.when(hit & vector, F.col("_hash"))}
    return state.with_(memories=m.select(*[F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in state.memories.columns]))


def touch(memories: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """Count one access of each id in the set."""
    hit = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("_hit", F.lit(True))
    m = memories.join(hit, "id", "left")
    changed = {"last_access_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_access_at")), "access_count": F.when(F.col("_hit"), F.col("access_count") + 1).otherwise(F.col("access_count"))}
    return m.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in memories.columns])


def close_edges(edges: DataFrame, ids: DataFrame, when: float) -> DataFrame:
    """End the validity of edges by id."""
    hit = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("_hit", F.lit(True))
    e = edges.join(hit, "id", "left").withColumn("valid_to", F.when(F.col("_hit"), F.lit(when)).otherwise(F.col("valid_to")))
    return e.select(*edges.columns)


def link(rows: DataFrame, now: float) -> DataFrame:
    """Edges from (src_id, dst_id) and optional columns, defaults filled in; the id comes from the content."""
    have = rows.columns

    def of(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    out = rows.select(
        "src_id", of("relation", F.lit("related_to")).alias("relation"), "dst_id", of("weight", F.lit(1.0)).alias("weight"), of("valid_from", F.lit(now)).alias("valid_from"),
        (F.col("valid_to") if "valid_to" in have else F.lit(None).cast("double")).alias("valid_to"), of("metadata", F.lit("{}")).alias("metadata"),
    )
    ident = F.substring(F.sha2(F.concat_ws("\x00", "src_id", "relation", "dst_id", F.col("valid_from").cast("string")), 256), 1, 32)
    return out.withColumn("id", ident).select(*[c.split()[0] for c in EDGE.split(", ")])


def reembed(memories: DataFrame, embedding) -> DataFrame:
    """Recompute every vector."""
    return memories.withColumn("embedding", embedding)


def check_dim(memories: DataFrame, dim: int) -> None:
    wrong = memories.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).limit(1)
    if not wrong.isEmpty():
        raise ValueError(f"a stored vector does not have {dim} dimensions; re-embed first")
