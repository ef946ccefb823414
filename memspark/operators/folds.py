"""Sequential folds: consolidation of episodes into facts, and playbooks from repeated work.

Every decision sees the writes before it. The parts that grow with the data (similarity search,
assignment to anchors) run distributed first; what is folded in order is read a row at a time, with the
candidates that its decision can use, or is one block of anchors.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta, text
from ..functions.hashing import hash_hex
from ..schema import L1, L2, L3, Config, MemoryState
from . import dml, graph, layers, scan, search

#: Episodes of a workspace in one pass of consolidation, and tasks that workspaces are dealt to.
CAP, FOLDS = 500, 64
ACTIONS = ("ADD", "UPDATE", "DELETE", "NOOP")
ANCHORS = 256
#: Rows that one task compares with a block of anchors.
PIECE = 16384


def ordered_episodes(memories: DataFrame, workspace: str = "", since: float = 0.0, cap: int | None = CAP) -> DataFrame:
    """Episodes by time (then id), the first ``cap`` of each workspace, with their place."""
    e = scan.memories(memories, workspace, L1)
    if since:
        e = e.where(F.col("created_at") >= since)
    if cap:
        return e.withColumn("place", F.row_number().over(Window.partitionBy("workspace").orderBy("created_at", "id"))).where(F.col("place") <= cap)
    # all of them: sorted ranges are numbered by themselves, then by what lies before them, so a workspace is no single task
    e = graph.written(e.repartitionByRange("workspace", "created_at", "id").withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = e.groupBy(F.col("workspace").alias("_w"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_w").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    e = e.withColumn("_at", F.row_number().over(Window.partitionBy("workspace", "_range").orderBy("created_at", "id")))
    e = e.join(F.broadcast(before), F.col("workspace").eqNullSafe(F.col("_w")) & (F.col("_range") == F.col("_r")))
    return e.withColumn("place", (F.col("_at") + F.col("_before")).cast("int")).drop("_w", "_r", "_range", "_at", "_before")


def decide(candidate_hash: str, similar: list[tuple[float, str, str]], threshold: float) -> str:
    """similar: (similarity, content hash, superseded_by) best first."""
    for _, h, by in similar:
        if h == candidate_hash:
            return "NOOP"
        if by == candidate_hash:
            return "UPDATE"
    return "UPDATE" if similar and similar[0][0] >= threshold else "ADD"


def _three(step):
    """A function of exactly (key, left, right)."""
    return lambda key, left, right: step(key, left, right)


def _log(state: MemoryState, config: Config, workspace: str, since: float, classify: Callable[[str, list[str]], tuple[str, str]] | None, cap: int | None) -> DataFrame:
    """``consolidation_log`` with root_id (the row that an UPDATE's chain of targets starts from) and near_summary (the nearest one told on the way).

    What never moves (rows that are no facts) bars what an episode can see: a fact shows only if fewer than ``near`` such rows stand
    before it. ``search.seen_classes`` finds those rows and the vectors that are not barred for each distinct vector, all at once; what
    is left to do in order is to look which facts stand at these vectors, a row at a time, so a task holds live facts only."""
    near = config.min_episodes_to_trigger + 5
    own_content = (lambda: F.lit(None).cast("string").alias("content")) if classify is None else (lambda: F.col("content"))  # contents travel only where a classifier reads them
    m = scan.memories(state.memories, workspace)
    # equal vectors of a workspace are one class, by 128 bits of hash
    key = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.reverse("embedding")))).alias("key")
    e = ordered_episodes(m.select("id", "layer", "workspace", "created_at", "content", "summary", key, F.col("embedding").isNotNull().alias("has")), "", since, cap)
    episodes = graph.written(e.where("has").select("workspace", "place", "id", "content", "summary", "key"), "episodes")
    v = scan.with_vectors(m, config.dim).select("workspace", key, "id", F.coalesce(F.col("layer") == L2, F.lit(False)).alias("fact"), F.col("embedding").cast("array<float>").alias("embedding"))
    same = ["workspace", "key"]
    classes = v.groupBy(*same).agg(F.min("id").alias("cls"), F.max("fact").alias("facts"), F.first("embedding").alias("embedding"))
    fixed = v.where("not fact").withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("r") <= near)
    fixed = fixed.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = episodes.groupBy(*same).agg(F.lit(True).alias("asked"))

    def on(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        r = right.withColumnsRenamed({"workspace": "_w", "key": "_k"})
        return left.join(r, F.col("workspace").eqNullSafe(F.col("_w")) & (F.col("key") == F.col("_k")), how).drop("_w", "_k")

    classes = on(on(classes, fixed), asked)
    classes = graph.written(classes.select(*same, "cls", "embedding", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("asked", F.lit(False)).alias("asked"), (F.col("facts") | F.col("asked").isNotNull()).alias("moves")), "classes")
    seen = graph.written(search.seen_classes(classes, near, 0.1), "seen")
    wanted = seen.select(F.explode("classes").alias("cls")).distinct()
    held = m.where(F.col("embedding").isNotNull() & (F.col("layer") == L2)).select("workspace", key, "id", "content_hash", meta.string("metadata", "superseded_by").alias("by"), own_content())
    held = on(held, classes.where("moves").join(wanted, "cls", "left_semi").select(*same, "cls"), "inner")
    nothing = {"sims": "array<double>", "classes": "array<string>", "fixed_sims": "array<double>", "fixed_ids": "array<string>"}
    held = held.select("workspace", F.lit(0).alias("place"), "id", "content", F.lit("").alias("summary"), "cls", "content_hash", "by", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    steps = on(episodes, seen).select("workspace", "place", "id", "content", "summary", "cls", F.lit("").alias("content_hash"), F.lit("").alias("by"), *nothing)

    def fold(batches):
        at, live = object(), {}  # class -> facts by id: (id, hash, by, content, root, summary)
        for pdf in batches:
            out = []
            for ws, place, i, text_, told, cls, hsh, by, sims, of, fixed_sims, fixed_ids in pdf.itertuples(index=False, name=None):
                if ws != at:
                    at, live = ws, {}
                if place == 0:
                    insort(live.setdefault(cls, []), (i, hsh, by, text_, i, None), key=_id)
                    continue
                pool, similar = [], []
                if of is not None and any(c in live for c in of):
                    for s, c in zip(sims, of):
                        pool += [(-s, f[0], c, f) for f in live.get(c, ())[:near]]
                    pool += [(-s, x, None, None) for s, x in zip(fixed_sims, fixed_ids)]
                    pool.sort(key=_place)
                    similar = [x for x in pool[:near] if x[3] is not None]
                own = hash_hex(text_.encode())
                if classify is None:
                    action, new_text = decide(own, [(-x[0], x[3][1], x[3][2]) for x in similar], threshold), text_
                else:
                    action, new_text = classify(text_, [x[3][3] for x in similar])
                new_id = target = content = root = summary = None
                if action == "ADD":
                    content = text_
                    root = new_id = hash_hex(f"add\x00{i}".encode())
                elif action in ("UPDATE", "DELETE") and similar:
                    _, target, c, (_, _, _, _, root, summary) = similar[0]
                    del live[c][bisect_left(live[c], target, key=_id)]
                    if not live[c]:
                        del live[c]
                    if action == "UPDATE":
                        content = new_text or text_
                        summary = told or summary
                        new_id = hash_hex(f"update\x00{i}\x00{target}".encode())
                if new_id and cls is not None:
                    insort(live.setdefault(cls, []), (new_id, hash_hex(content.encode()), "", None if classify is None else content, root, summary), key=_id)
                out.append((ws, place, i, action, len(similar), new_id, target, content, root, summary))
            yield pd.DataFrame(out, columns=["workspace", "place", "episode_id", "action", "n_similar", "new_id", "target_id", "content", "root_id", "near_summary"])

    threshold = config.dedup_similarity
    shape = "workspace string, place int, episode_id string, action string, n_similar int, new_id string, target_id string, content string, root_id string, near_summary string"
    return graph.written(held.unionByName(steps).repartition(FOLDS, "workspace").sortWithinPartitions("workspace", "place", "id").mapInPandas(fold, shape), "log")


def _id(fact: tuple) -> str:
    return fact[0]


def _place(x: tuple) -> tuple:
    return x[:2]


def consolidation_log(state: MemoryState, config: Config = Config(), workspace: str = "", since: float = 0.0, classify: Callable[[str, list[str]], tuple[str, str]] | None = None, cap: int | None = CAP) -> DataFrame:
    """What consolidation would do: workspace, place, episode_id, action, n_similar, new_id, target_id,
    content (of the new row), for each episode in order; a pass takes ``cap`` episodes of a workspace, or all.

    The search is inside the workspace over every vector there, episodes included; a retired row has no
    vector, so it is not searchable."""
    return _log(state, config, workspace, since, classify, cap).drop("root_id", "near_summary")


def consolidate(state: MemoryState, now: float, embedding, config: Config = Config(), workspace: str = "", since: float = 0.0, classify=None, cap: int | None = CAP) -> tuple[MemoryState, DataFrame]:
    """(new state, log). ADD writes a fact; UPDATE writes a clone of its target with new content (keeping
    created_at, access, tags and source) and retires the target; DELETE retires it."""
    log = _log(state, config, workspace, since, classify, cap)
    ep = state.memories.select(F.col("id").alias("episode_id"), F.col("summary").alias("ep_summary"), F.col("tags").alias("ep_tags"), F.col("metadata").alias("ep_metadata"))
    adds = log.where("action = 'ADD'").join(ep, "episode_id").select(
        F.col("new_id").alias("id"), "workspace", "content", F.col("ep_summary").alias("summary"), F.col("ep_tags").alias("tags"), meta.with_entries("ep_metadata", source_episode=F.col("episode_id")).alias("metadata"), F.lit("consolidate").alias("source")
    )
    made = layers.facts(adds, now, embedding)
    # a target may itself be new in this pass: what a clone keeps is that of the oldest row of its chain, and the nearest summary on the way
    updates = log.where("action = 'UPDATE' and new_id is not null").select("new_id", "target_id", "episode_id", "content", F.col("root_id").alias("to"), "near_summary")
    base = dml.upsert(state.memories, made, "id")
    t = base.select(F.col("id").alias("to"), *[F.col(c).alias(f"t_{c}") for c in layers.COLUMNS if c != "id"])
    c = updates.join(t, "to")
    from ..functions.hashing import content_hash

    clones = c.select(
        F.col("new_id").alias("id"), F.col("t_layer").alias("layer"), F.col("t_type").alias("type"), "content", F.coalesce("near_summary", "t_summary").alias("summary"), F.col("t_tags").alias("tags"),
        meta.with_entries("t_metadata", source_episode=F.col("episode_id"), updated_from=F.col("target_id")).alias("metadata"), F.col("t_source").alias("source"), F.col("t_workspace").alias("workspace"), F.col("t_created_at").alias("created_at"),
        F.lit(now).alias("updated_at"), F.col("t_last_access_at").alias("last_access_at"), F.col("t_access_count").alias("access_count"), F.col("t_activation").alias("activation"),
    )
    clones = clones.withColumn("content_hash", content_hash("content")).withColumn("embedding", embedding("content")).select(*layers.COLUMNS)
    new = graph.written(made.select(*layers.COLUMNS).unionByName(clones), "consolidated")
    after = dml.put_memories(state, new)
    pairs = log.where("target_id is not null").select(F.col("target_id").alias("old_id"), "new_id")
    return graph.retire(after, pairs, now), log.drop("root_id", "near_summary")


def action_counts(log: DataFrame, key: str = "workspace") -> DataFrame:
    """Counts of each action, zeros filled in."""
    return log.groupBy(key).pivot("action", list(ACTIONS)).count().fillna(0)


def greedy_clusters(rows: DataFrame, threshold: float, min_size: int = 3, key: str = "workspace", block: int = ANCHORS, piece: int = PIECE) -> DataFrame:
    """rows (key, id, place, embedding) -> key, anchor_id, anchor_place, id, place, size.

    The first row not yet taken becomes an anchor and takes every later free row that is similar enough;
    clusters below ``min_size`` are not reported, but keep what they took. Anchors are found in blocks of
    the first free rows of each key; the rest is then assigned to the earliest anchor in parallel."""
    kind = rows.schema["id"].dataType.simpleString()
    left = graph.written(rows.select(key, "id", "place", "embedding"), "free")
    taken = None

    def units(column):
        m = np.array([np.asarray(v, float) for v in column])
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        m = units(pdf["embedding"])
        of = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if of[i] < 0:
                of[i] = i
                later = np.flatnonzero((of < 0) & (m @ m[i] >= threshold))
                of[later[later > i]] = i
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "place": pdf["place"].to_numpy(), "anchor_id": pdf["id"].to_numpy()[of], "anchor_place": pdf["place"].to_numpy()[of]})

    def claim(group: tuple, free: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=[key, "id", "place", "anchor_id", "anchor_place"])
        if not len(free) or not len(a):
            return empty
        a = a.sort_values("place")
        sims = units(free["embedding"]) @ units(a["embedding"]).T >= threshold
        hit = sims.any(axis=1)
        first = sims.argmax(axis=1)[hit]
        f = free[hit]
        if not len(f):
            return empty
        return pd.DataFrame({key: f[key].to_numpy(), "id": f["id"].to_numpy(), "place": f["place"].to_numpy(), "anchor_id": a["id"].to_numpy()[first], "anchor_place": a["place"].to_numpy()[first]})

    shape = f"{key} {rows.schema[key].dataType.simpleString()}, id {kind}, place int, anchor_id {kind}, anchor_place int"
    while not left.isEmpty():
        w = Window.partitionBy(key).orderBy("place")
        head = graph.written(left.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= block).drop("_r"), "head")
        got = graph.written(head.groupBy(key).applyInPandas(anchors, shape), "anchors")
        rest = left.join(head.select("id"), "id", "left_anti")
        leaders = got.where("id = anchor_id").select("id").join(head, "id").select(key, "id", "place", "embedding")
        sizes = graph.written(rest.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count(F.lit(1)) / piece).alias("_pieces")), "pieces")
        spread = leaders.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).select(key, "id", "place", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("piece"))
        dealt = rest.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).select(key, "id", "place", "embedding", F.pmod(F.xxhash64("id"), F.col("_pieces")).alias("piece"))
        claimed = graph.written(dealt.groupBy(key, "piece").cogroup(spread.groupBy(key, "piece")).applyInPandas(claim, shape), "claimed")
        both = got.unionByName(claimed)
        taken = both if taken is None else taken.unionByName(both)
        left = graph.written(rest.join(claimed.select("id"), "id", "left_anti"), "free")
    if taken is None:
        return rows.sparkSession.createDataFrame([], shape + ", size long")
    sizes = taken.groupBy(key, "anchor_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return taken.join(sizes, [key, "anchor_id"])


def playbook_candidates(state: MemoryState, workspace: str = "", min_size: int = 3, threshold: float = 0.55) -> DataFrame:
    """workspace, anchor_id, size, action_verb, name, steps, preconditions, content of each cluster of successes."""
    e = ordered_episodes(state.memories.select("id", "layer", "workspace", "created_at", "embedding", "metadata"), workspace, cap=None).where(F.col("embedding").isNotNull())
    e = e.withColumn("outcome", meta.string("metadata", "outcome")).where(F.col("outcome").isin("success", "ok", "done"))
    enough = e.groupBy("workspace").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_size).select("workspace")
    e = graph.written(e.join(enough, "workspace", "left_semi"), "successes")
    clusters = greedy_clusters(e, threshold, min_size).select("workspace", "anchor_id", "anchor_place", "id", "size")
    got = graph.written(clusters.join(e.drop("workspace"), "id"), "clusters")
    got = got.withColumn("verb", F.when(meta.string("metadata", "action") == "", "do").otherwise(meta.string("metadata", "action"))).withColumn("agent", F.when(meta.string("metadata", "agent") == "", "agent").otherwise(meta.string("metadata", "agent")))
    seen = meta.string("metadata", "observation")
    got = got.withColumn("step", F.concat(meta.string("metadata", "action"), F.when(seen != "", F.concat(F.lit(" — "), seen)).otherwise("")))
    keys = ["workspace", "anchor_id"]
    verbs = got.groupBy(*keys, "verb").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at")).groupBy(*keys).agg(F.max_by("verb", F.struct("n", -F.col("at"))).alias("action_verb"))

    def first_seen(column, name):
        once = got.where(F.col(column) != "").groupBy(*keys, column).agg(F.min("place").alias("at"))
        return once.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", column))), lambda x: x[column]).alias(name))

    out = got.select(*keys, "anchor_place", "size").distinct().join(verbs, keys).join(first_seen("step", "steps"), keys, "left").join(first_seen("agent", "preconditions"), keys, "left")
    out = out.withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
    out = out.withColumn("name", F.concat(F.lit("How to "), "action_verb", F.lit(" ("), F.col("size").cast("string"), F.lit(" episodes)")))
    return out.withColumn("content", text.playbook_content("name", "steps"))


def proceduralize(state: MemoryState, now: float, embedding, config: Config = Config(), workspace: str = "", min_size: int = 3, threshold: float = 0.55) -> tuple[MemoryState, DataFrame]:
    """(new state, details): a playbook for each cluster, unless one with its hash exists (NOOP); a similar
    live one is superseded (UPDATE). Clusters of a workspace are folded in order."""
    cand = graph.written(playbook_candidates(state, workspace, min_size, threshold).withColumn("embedding", embedding("content")), "candidates")
    near = config.min_episodes_to_trigger + 5
    vectors = scan.with_vectors(state.memories, config.dim)
    n = int(cand.groupBy("workspace").count().agg(F.max("count").alias("n")).first()["n"] or 0)
    m = state.memories.select("id", "layer", "type", "content_hash", meta.retired("metadata").alias("gone"))

    def found(some: DataFrame, k: int) -> DataFrame:
        hits = graph.written(search.top_k_within(vectors, some.select("workspace", F.col("anchor_id").alias("query_id"), "embedding"), k), "hits")
        return hits.join(m, "id").select("workspace", "query_id", "id", "similarity", "layer", "type", "content_hash", "gone")

    def fold(key: tuple, c: pd.DataFrame, h: pd.DataFrame, k: int) -> pd.DataFrame:
        found = {q: g.sort_values(["similarity", "id"], ascending=[False, True]) for q, g in h.groupby("query_id")}
        fresh, gone, out, short = [], set(), [], False
        for r in c.sort_values("anchor_place").itertuples(index=False):
            v = np.asarray(r.embedding, float)
            pool = [(float(x.similarity), x.id, x.layer == L3 and x.type == "playbook" and not x.gone, x.content_hash) for x in (found[r.anchor_id].itertuples(index=False) if r.anchor_id in found else ()) if x.id not in gone]
            short |= r.anchor_id in found and len(found[r.anchor_id]) >= k and len(pool) < near
            pool += [(float(v @ w), i, True, hsh) for i, w, hsh in fresh if i not in gone]
            pool.sort(key=lambda x: (-x[0], x[1]))
            similar = [x for x in pool[:near] if x[0] >= 0.1 and x[2]]
            own = hash_hex(r.content.encode())
            action = "NOOP" if any(x[3] == own for x in similar) else "UPDATE" if similar and similar[0][0] >= threshold else "ADD"
            new_id = target = None
            if action != "NOOP":
                new_id = hash_hex(f"playbook\x00{r.anchor_id}\x00{r.content}".encode())
                fresh.append((new_id, v, own))
                if action == "UPDATE":
                    target = similar[0][1]
                    gone.add(target)
            out.append((key[0], r.anchor_id, action, r.action_verb, int(r.size), new_id, target))
        rows = pd.DataFrame(out, columns=["workspace", "anchor_id", "action", "action_verb", "size", "new_id", "target_id"])
        return rows.assign(short=short)

    # a pass retires at most as many targets as a workspace has clusters, so near + n neighbours are always enough; where fewer
    # fall short, a workspace is folded again with more of them
    shape = "workspace string, anchor_id string, action string, action_verb string, size long, new_id string, target_id string, short boolean"
    some, details, k = cand.select("workspace", "anchor_id", "anchor_place", "content", "action_verb", "size", "embedding"), None, 4 * near
    while True:
        k = min(k, near + n)

        def step(key: tuple, c: pd.DataFrame, h: pd.DataFrame, k=k) -> pd.DataFrame:
            return fold(key, c, h, k)

        got = graph.written(some.groupBy("workspace").cogroup(found(some, k).groupBy("workspace")).applyInPandas(_three(step), shape), "details")
        done = (got if k == near + n else got.where("not short")).drop("short")
        details = done if details is None else details.unionByName(done)
        again = got.where("short").select("workspace").distinct()
        if k == near + n or again.isEmpty():
            break
        some, k = some.join(again, "workspace", "left_semi"), 8 * k
    details = graph.written(details, "details")
    new = details.where("new_id is not null").join(cand.select("anchor_id", "name", "steps", "preconditions"), "anchor_id").select(F.col("new_id").alias("id"), "workspace", "name", "steps", "preconditions", F.lit("success").alias("expected_outcome"), F.array("action_verb").alias("tags"))
    after = dml.put_memories(state, layers.playbooks(new, now, embedding))
    return graph.retire(after, details.where("target_id is not null").select(F.col("target_id").alias("old_id"), "new_id"), now), details
