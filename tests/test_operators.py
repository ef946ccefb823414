import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark import streaming
from memspark.engine import MemoryEngine
from memspark.functions import meta
from memspark.functions.hashing import hash_embed
from memspark.operators import attention, code_index, cycle, dml, folds, graph, layers, metrics, recall, scan, search, stats
from memspark.schema import L1, L2, L5, L6, Config, MemoryState, System2Config
from memspark.sources import datasets, store

NOW = 1_000_000.0
DIM = 64


def embed(c):
    return hash_embed(c, DIM)


def memories(spark, rows, **given):
    """rows: (id, content[, dict])."""
    data = [(r[0], r[1], *[(r[2] if len(r) > 2 else {}).get(k) for k in ("workspace", "metadata", "created_at", "layer", "type", "source")]) for r in rows]
    df = spark.createDataFrame(data, "id string, content string, workspace string, metadata string, created_at double, layer string, type string, source string")
    df = df.withColumn("layer", F.coalesce("layer", F.lit(given.get("layer", L2)))).withColumn("type", F.coalesce("type", F.lit(given.get("type", "fact"))))
    from memspark.functions.hashing import content_hash

    return layers.memory_rows(df, NOW, embed, content_hash=content_hash("content"))


def state_of(spark, rows, edges=(), **given):
    s = MemoryState.empty(spark, memories=graph.written(memories(spark, rows, **given), "m"))
    if edges:
        e = spark.createDataFrame([(*e, *[None] * (4 - len(e))) for e in edges], "src_id string, relation string, dst_id string, valid_to double")
        s = dml.put_edges(s, dml.link(e, 0.0))
    return s


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


# --- search


def golden(seed):
    return [math.sin(seed * 31 + i * 7 + 1) + 0.5 * math.cos(seed * 13 - i * 3 + 2) for i in range(8)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_top_k_brute_force(spark, partitions):
    vs = [(f"v{k:02d}", golden(k)) for k in range(24)]
    qs = [(q, golden(q)) for q in (100, 200, 7)]
    got = search.top_k(spark.createDataFrame(vs, "id string, embedding array<float>").repartition(partitions), spark.createDataFrame(qs, "query_id long, embedding array<float>"), 5).collect()
    for q, x in qs:
        x = np.array(x) / np.linalg.norm(x)
        want = sorted(((-float(np.array(v) @ x / np.linalg.norm(v)), i) for i, v in vs))[:5]
        mine = sorted((r["rank"], r["id"], r["similarity"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == [w[1] for w in want]
        np.testing.assert_allclose([m[2] for m in mine], [-w[0] for w in want], atol=1e-5)


def test_top_k_ties_and_degenerate(spark):
    v = spark.createDataFrame([("z", [0.0, 0.0]), ("b", [0.0, 1.0]), ("a", [1.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [1.0, 0.0, 0.0]), ("n", None)], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "query_id int, embedding array<float>")
    got = {}
    for r in sorted(search.top_k(v, q, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: ["a", "b", "z"], 2: ["a", "b", "c"], 3: ["a", "b", "z"]}
    with pytest.raises(ValueError):
        search.top_k(v, q, 0)


# --- writes


def test_upsert_keeps_created_at(spark):
    s = state_of(spark, [("a", "old", {"created_at": 1.0}), ("b", "stay")])
    s = dml.put_memories(s, memories(spark, [("a", "new", {"created_at": 9.0}), ("c", "fresh")]))
    got = {r["id"]: (r["content"], r["created_at"]) for r in s.memories.collect()}
    assert got["a"] == ("new", 1.0) and got["b"][0] == "stay" and got["c"][0] == "fresh" and len(got) == 3


def test_delete_cascades_and_edges_need_ends(spark):
    s = state_of(spark, [("a", "x"), ("b", "y"), ("c", "z")], [("a", "r", "b"), ("b", "r", "c"), ("a", "r", "gone")])
    assert s.edges.count() == 2
    s = dml.delete(s, spark.createDataFrame([("b",)], "id string"))
    assert ids(s.memories) == ["a", "c"] and s.edges.count() == 0


def test_patch_touch_close(spark):
    s = state_of(spark, [("a", "x"), ("b", "y")], [("a", "r", "b")])
    p = spark.createDataFrame([("a", "new", None), ("q", "none", None)], "id string, content string, embedding array<float>")
    m = dml.patch_content(s, p, 5.0).memories
    assert {r["id"]: r["content"] for r in m.collect()} == {"a": "new", "b": "y"}
    t = dml.touch(s.memories, spark.createDataFrame([("a",), ("a",)], "id string"), 7.0)
    assert {r["id"]: r["access_count"] for r in t.collect()} == {"a": 1, "b": 0}
    assert dml.close_edges(s.edges, s.edges.select("id"), 3.0).first()["valid_to"] == 3.0
    assert dml.append_refs(dml.append_refs(s, r := spark.createDataFrame([("a", "b", "calls", "w", "f")], s.refs.schema)), r).refs.count() == 2
    with pytest.raises(ValueError):
        dml.check_dim(s.memories, 3)


def test_scans(spark):
    m = memories(spark, [("a", "x", {"workspace": "w"}), ("b", "y", {"workspace": "v", "metadata": '{"superseded":true}'})])
    assert ids(scan.memories(m, "w")) == ["a"] and ids(scan.memories(m)) == ["a", "b"] and ids(scan.live(m)) == ["a"]
    assert ids(m.where(scan.one_of("workspace", None))) == ["a", "b"] and ids(m.where(scan.one_of("workspace", []))) == []
    assert ids(scan.tenant(m, "w")) == ["a"] and ids(scan.tenant(m, "w", admin=True)) == ["a", "b"]
    t = spark.createDataFrame([("k", "1")], "key string, value string")
    assert scan.meta_value(t, "k").first()[0] == "1" and scan.meta_value(t, "q").first()[0] == ""


# --- graph


def test_retire(spark):
    s = state_of(spark, [("a", "x", {"metadata": '{"k":1}'}), ("b", "y"), ("c", "z")], [("c", "r", "a"), ("a", "r", "b"), ("b", "r", "c")])
    s = graph.retire(s, spark.createDataFrame([("a", "b"), ("c", None)], "old_id string, new_id string"), 9.0)
    m = {r["id"]: r for r in s.memories.collect()}
    assert json.loads(m["a"]["metadata"]) == {"k": 1, "superseded_at": 9.0, "superseded_by": "b"} and m["a"]["embedding"] is None
    assert json.loads(m["c"]["metadata"])["superseded"] is True and m["b"]["embedding"] is not None
    e = {(r["src_id"], r["relation"], r["dst_id"]): r["valid_to"] for r in s.edges.collect()}
    assert e == {("c", "r", "a"): 9.0, ("a", "r", "b"): 9.0, ("b", "r", "c"): 9.0, ("a", "supersedes", "b"): None}


def test_neighbours_counts_reach(spark):
    s = state_of(spark, [(x, x) for x in "abcd"], [("a", "r", "b"), ("b", "q", "c"), ("c", "r", "d", 1.0), ("a", "r", "a")])
    assert {r["id"]: r["n"] for r in graph.neighbour_counts(s.edges).collect()} == {"a": 3, "b": 2, "c": 1}
    one = spark.createDataFrame([("a",)], "id string")
    assert sorted(r["other"] for r in graph.neighbours(s.edges, one).collect()) == ["a", "b"]
    assert {r["id"]: r["depth"] for r in graph.reach(s.edges, one, 2).collect()} == {"b": 1, "c": 2}


def test_chain(spark):
    links = [("a", "supersedes", "b"), ("b", "supersedes", "c"), ("x", "supersedes", "y"), ("y", "supersedes", "x")]
    s = state_of(spark, [(i, i) for i in "abcxyz"], links)
    got = {r["start"]: r["latest"] for r in graph.latest_in_chain(s.edges, s.memories.select("id")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "x", "z": "z"}


def test_components(spark):
    v = spark.createDataFrame([("w", "a", [1.0, 0.0]), ("w", "b", [1.0, 0.0]), ("w", "c", [0.0, 1.0]), ("v", "d", [1.0, 0.0])], "workspace string, id string, embedding array<float>")
    assert {(r["id"], r["component"]) for r in cycle.clusters(v, 0.9, 2).collect()} == {("a", "a"), ("b", "a")}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}


# --- recall


def ask(spark, query, ws="default"):
    return spark.createDataFrame([(1, query, ws)], "query_id int, query string, workspace string").withColumn("embedding", embed("query"))


def test_recall_tiers(spark):
    rows = [("a", "jwt token expiry is 24h"), ("b", "jwt token rotation"), ("c", "unrelated text here"), ("old", "jwt token stale", {"metadata": '{"superseded_by":"a"}'}), ("f", "jwt token", {"workspace": "other"})]
    s = state_of(spark, rows, [("a", "related_to", "c")])
    got = recall.recall(s, ask(spark, "jwt token"), NOW, Config(dim=DIM), top_k=2).collect()
    assert sorted(r["id"] for r in got) == ["a", "b"] and {r["tier_reached"] for r in got} == {1} and all(r["sufficient"] for r in got)
    got = recall.recall(s, ask(spark, "jwt zebra quagga okapi"), NOW, Config(dim=DIM), top_k=5, min_similarity=0.05).collect()
    assert {r["tier_reached"] for r in got} == {2} and not got[0]["sufficient"]
    via = {r["id"]: r["via"] for r in got if r["tier"] == 2}
    assert via == {"c": ["a", "c"]}
    assert recall.recall(s, ask(spark, "jwt"), NOW, Config(dim=DIM), layers=[]).count() == 0
    with pytest.raises(ValueError):
        recall.recall(s, ask(spark, "jwt"), NOW, Config(dim=DIM), top_k=-1)


def test_expand_rules(spark):
    rows = [("a", "x"), ("n", "x"), ("m", "x"), ("k", "x"), ("far", "x"), ("foreign", "x", {"workspace": "o"}), ("s", "x", {"type": "code_symbol", "metadata": '{"file_path":"p.py"}'}), ("file", "x", {"type": "code_file", "metadata": '{"file_path":"p.py"}'})]
    links = [("a", "supersedes", "n"), ("n", "r", "m"), ("a", "r", "k"), ("k", "r", "s"), ("s", "r", "far"), ("a", "r", "foreign")]
    s = state_of(spark, rows, links)
    anchors = spark.createDataFrame([(1, "default", "a", 1, 1.0)], "query_id int, workspace string, id string, rank int, score double")
    got = {r["id"]: (round(r["similarity"], 3), r["via"]) for r in recall.expand(s, anchors, 2).collect()}
    assert got == {"n": (0.6, ["a", "n"]), "k": (0.5, ["a", "k"]), "s": (0.25, ["a", "k", "s"]), "file": (0.1, ["s", "file"])}


# --- gate, folds, maintenance


def test_gate(spark):
    old = memories(spark, [("e", "seen before", {"layer": L1, "created_at": NOW - 10})])
    r = spark.createDataFrame([("1", "ok", L2), ("2", "seen before", L2), ("3", "news", L2), ("4", "ok", "L0_working")], "id string, content string, layer string").withColumn("workspace", F.lit("default"))
    got = {x["id"]: (x["action"], x["reason"]) for x in attention.gate(r, old, NOW).collect()}
    assert got == {"1": ("drop", "noise"), "2": ("drop", "duplicate"), "3": ("pass", ""), "4": ("pass", "working memory never gated")}
    judged = {x["id"]: (x["action"], x["content"]) for x in attention.gate(r, old, NOW, judge=lambda ts: [("rewrite", t.upper()) for t in ts]).collect()}
    assert judged["3"] == ("rewrite", "NEWS") and judged["1"][0] == "drop"


def episode(spark, rows):
    """rows: (id, action, outcome, created_at[, workspace])."""
    df = spark.createDataFrame([(r[0], "u", r[1], "", r[2], float(r[3]), r[4] if len(r) > 4 else "default") for r in rows], "id string, agent string, action string, observation string, outcome string, created_at double, workspace string")
    return graph.written(layers.episodes(df, NOW, embed), "e")


def test_consolidate(spark):
    s = MemoryState.empty(spark, memories=episode(spark, [("1", "deploy service alpha to production", "", 1), ("2", "deploy service alpha to production", "", 2), ("3", "deploy service alpha to production now", "", 3), ("4", "water the plants", "", 4)]))
    s, log = folds.consolidate(s, NOW, embed, Config(dim=DIM))
    assert [(r["episode_id"], r["action"]) for r in log.orderBy("place").collect()] == [("1", "ADD"), ("2", "NOOP"), ("3", "UPDATE"), ("4", "ADD")]
    facts = s.memories.where("layer = 'L2_semantic'")
    live = scan.live(facts)
    assert facts.count() == 3 and live.count() == 2
    new = live.where(F.col("content").contains("now")).first()
    m = json.loads(new["metadata"])
    assert m["source_episode"] == "3" and "updated_from" in m and new["source"] == "consolidate"
    c = folds.action_counts(log).first()
    assert (c["ADD"], c["UPDATE"], c["DELETE"], c["NOOP"]) == (2, 1, 0, 1)
    _, again = folds.consolidate(s, NOW, embed, Config(dim=DIM), classify=lambda content, similar: ("DELETE", "") if similar else ("NOOP", ""))
    assert {r["action"] for r in again.collect()} <= {"DELETE", "NOOP"}


def test_consolidate_cap(spark):
    s = MemoryState.empty(spark, memories=episode(spark, [(f"{k:04d}", "same thing", "", k) for k in range(501)]))
    log = folds.consolidation_log(s, Config(dim=DIM))
    # the episodes themselves, all as similar, take the slots of the search
    assert log.count() == 500 and {r["action"] for r in log.collect()} == {"ADD"}


def greedy(vs, t, least):
    taken, out = [None] * len(vs), {}
    for i in range(len(vs)):
        if taken[i] is not None:
            continue
        taken[i] = i
        for j in range(i + 1, len(vs)):
            if taken[j] is None and vs[i] @ vs[j] >= t:
                taken[j] = i
    for i, a in enumerate(taken):
        out.setdefault(a, []).append(i)
    return sorted(x for x in out.values() if len(x) >= least)


@pytest.mark.parametrize("block", [3, 256])
def test_greedy_clusters_brute_force(spark, block):
    r = np.random.default_rng(3)
    vs = r.normal(size=(60, 3))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    rows = spark.createDataFrame([("w", k, k, [float(x) for x in v]) for k, v in enumerate(vs)], "workspace string, id int, place int, embedding array<double>")
    got = {}
    for x in folds.greedy_clusters(rows, 0.8, 3, block=block).collect():
        got.setdefault(x["anchor_id"], []).append(x["id"])
    assert sorted(sorted(x) for x in got.values()) == greedy(vs, 0.8, 3)


def test_proceduralize(spark):
    rows = [(f"e{k}", "run the deploy script", o, k) for k, o in enumerate(("success", "ok", "done", "success", "failure"))]
    s = MemoryState.empty(spark, memories=episode(spark, rows))
    s, details = folds.proceduralize(s, NOW, embed, Config(dim=DIM))
    d = details.collect()
    assert [(x["action"], x["action_verb"], x["size"]) for x in d] == [("ADD", "run the deploy script", 4)]
    book = s.memories.where("type = 'playbook'").first()
    assert book["content"] == "How to run the deploy script (4 episodes)\n1. run the deploy script" and book["tags"] == ["run the deploy script", "playbook"]
    _, again = folds.proceduralize(s, NOW, embed, Config(dim=DIM))
    assert [x["action"] for x in again.collect()] == ["NOOP"]


def test_models_and_merge(spark):
    rows = [(f"f{k}", "the cat sat on the mat") for k in range(3)] + [("g", "nothing alike")]
    s = state_of(spark, rows)
    fake = cycle.FakeProvider({"title": "Cats", "model": "they sit"})
    conf = Config(dim=DIM, system2=System2Config(l5_merge_every=5))
    s, details = cycle.extract_models(s, NOW, embed, fake, conf)
    assert [(r["n_members"], r["action"]) for r in details.collect()] == [(3, "new")]
    assert s.edges.where("relation = 'abstracts'").count() == 3 and scan.meta_value(s.meta, cycle.CYCLE_KEY).first()[0] == "1"
    assert ids(cycle.abstractable(s)) == ["g"]
    s2, d2 = cycle.extract_models(s, NOW, embed, fake, conf)
    assert d2.count() == 0
    twin = memories(spark, [("m2", "Cats: they sit", {"layer": L5, "type": "mental_model"})])
    s3 = dml.put_edges(dml.put_memories(s2, twin), dml.link(spark.createDataFrame([("m2", "abstracts", "g")], "src_id string, relation string, dst_id string"), NOW))
    s4, d4 = cycle.merge_models(s3, NOW + 1, embed, fake, conf)
    assert [(r["n_members"], r["action"]) for r in d4.collect()] == [(4, "merged")]
    assert scan.live(s4.memories.where(F.col("layer") == L5)).count() == 1
    assert cycle.extract_models(s, NOW, embed, None)[1] is None


def test_merge_takes_an_advanced_clustering(spark):
    from memspark.operators.clustering import Clustering

    fake = cycle.FakeProvider({"title": "Cats", "model": "they sit"})
    conf = Config(dim=DIM)
    model = lambda i, text: (i, text, {"layer": L5, "type": "mental_model"})
    base = MemoryState.empty(spark, memories=memories(spark, [("f1", "one"), ("f2", "two"), model("m1", "Cats: they sit"), model("m3", "nothing alike")]))
    links = spark.createDataFrame([("m1", "abstracts", "f1"), ("m2", "abstracts", "f2"), ("m3", "abstracts", "f2")], "src_id string, relation string, dst_id string")
    after = dml.put_edges(dml.put_memories(base, memories(spark, [model("m2", "Cats: they sit")])), dml.link(links, NOW))
    c = Clustering.of(cycle.live_models(base, embed), conf.system2.l5_merge_similarity).advance(cycle.live_models(after, embed))
    got = [cycle.merge_models(after, NOW + 1, embed, fake, conf, clustering=x) for x in (None, c)]
    rows = [sorted(map(repr, d.select("n_members", "action").collect())) for _, d in got]
    live = [sorted(r["content"] for r in scan.live(s.memories.where(F.col("layer") == L5)).collect()) for s, _ in got]
    assert rows[0] == rows[1] and len(rows[0]) == 1 and live[0] == live[1] == ["Cats: they sit", "nothing alike"]


def test_intents(spark):
    rows = [("x1", "gone", {"layer": L6, "metadata": '{"valid_to": 5}'}), ("x2", "gone", {"layer": L6}), ("x3", "keep", {"layer": L6, "metadata": '{"valid_to":"soon"}'}), ("x4", "keep", {"layer": L6, "metadata": f'{{"valid_to":"{NOW + 9}"}}'})]
    s = state_of(spark, rows)
    s = s.with_(memories=s.memories.unionByName(episode(spark, [("e1", "a", "", 1), ("e2", "b", "", 2)])))
    fake = cycle.FakeProvider({"intents": [{"intent": " ship it "}, {"intent": ""}, "no", {"intent": "rest", "confidence": 0.9, "horizon_s": 10}]})
    s, d = cycle.predict_intents(s, NOW, embed, fake, Config(dim=DIM))
    assert {(r["intent"], r["confidence"], r["valid_to"]) for r in d.collect()} == {("ship it", 0.5, NOW + 3 * 86400), ("rest", 0.9, NOW + 10)}
    gone = {r["id"] for r in s.memories.where(meta.retired("metadata")).collect()}
    assert gone == {"x1", "x2"}
    _, again = cycle.predict_intents(s, NOW, embed, fake, Config(dim=DIM))
    assert again.count() == 0
    bad = cycle.FakeProvider({})
    bad.complete_structured = lambda *a: 1 / 0
    fresh = s.with_(memories=s.memories.unionByName(episode(spark, [("e3", "c", "", 3)])))
    with pytest.raises(Exception):
        cycle.predict_intents(fresh, NOW, embed, bad, Config(dim=DIM))


def test_decay(spark):
    m = episode(spark, [("old", "x", "", 1), ("new", "y", "", 2)]).withColumn("last_access_at", F.when(F.col("id") == "old", F.lit(NOW - 60 * 86400)).otherwise(NOW))
    s = MemoryState.empty(spark, memories=m)
    after, report = cycle.decay(s, NOW, workspace=None)
    r = report.first()
    assert (r["examined"], r["forgotten"], r["forgotten_ids"]) == (2, 1, ["old"]) and ids(after.memories) == ["new"]
    same, _ = cycle.decay(s, NOW, workspace=None, dry_run=True)
    assert ids(same.memories) == ["new", "old"]


# --- code, metrics, stores

SOURCE = '''import os

def helper(x):
    """Says hi."""
    return len(x)

class Service(Base):
    """A service."""
    def run(self):
        return helper(self.name)
    @property
    def name(self):
        return "n"

@deco
def hidden():
    pass
'''


def test_python_symbols():
    got = code_index.python_symbols(SOURCE)
    assert [(s["symbol_kind"], s["parent"], s["name"], s["signature"]) for s in got] == [("function", "", "helper", "def helper(x)"), ("class", "", "Service", "class Service"), ("function", "Service", "run", "def run(self)")]
    assert got[0]["docstring"] == "Says hi." and got[0]["calls"] == ["len"]


def test_index_code(spark):
    files = spark.createDataFrame([("w", "auth/service.py", SOURCE), ("w", "bad.py", "def (:\n" * 3), ("w", "notes.txt", "x"), ("w", "page.html", "a\r\nb"), ("w", "node_modules/x.js", "x")], "workspace string, path string, content string")
    s, report = code_index.index_code(MemoryState.empty(spark), files, NOW, embed, Config(dim=DIM))
    s = MemoryState(**{k: graph.written(getattr(s, k), k) for k in MemoryState.SCHEMAS})
    r = report.first()
    assert (r["files_seen"], r["files_skipped_unsupported"], r["files_indexed"], r["files_skipped_unchanged"], r["refs_written"]) == (4, 1, 3, 0, 2) and len(r["errors"]) == 1
    names = {x["qualified_name"] for x in s.symbols.collect()}
    assert names == {"auth.service.helper", "auth.service.Service", "auth.service.Service.run", "bad.lines_1", "page.html.lines_1"}
    assert {(x["src_symbol"], x["dst_symbol"]) for x in s.refs.collect()} == {("auth.service.Service.run", "auth.service.helper"), ("auth.service.Service", "auth.service.helper")}
    s2, again = code_index.index_code(s, files, NOW, embed, Config(dim=DIM))
    r = again.first()
    assert (r["files_indexed"], r["files_skipped_unchanged"]) == (0, 3) and s2.symbols.count() == 5
    changed = files.where("path <> 'page.html'").withColumn("content", F.when(F.col("path") == "auth/service.py", "def only():\n    pass\n").otherwise(F.col("content")))
    s3, _ = code_index.index_code(s, changed, NOW, embed, Config(dim=DIM), prune=True)
    assert {x["qualified_name"] for x in s3.symbols.collect()} == {"auth.service.only", "bad.lines_1"}


def test_chunks(spark):
    df = spark.createDataFrame([("a", "\n".join(map(str, range(85)))), ("e", "")], "path string, content string")
    got = sorted((r["path"], r["line_start"], r["line_end"]) for r in code_index.chunks(df).collect())
    assert got == [("a", 1, 40), ("a", 41, 80), ("a", 81, 85), ("e", 1, 1)]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), (["x"], []), (["b", "a"], ["a"])], "r array<string>, g array<string>")
    got = df.select(metrics.recall_all("r", "g", 3).alias("a"), metrics.recall_all("r", "g", 2).alias("b"), metrics.ndcg("r", "g", 3).alias("n"), metrics.recall_any("r", "g", 1).alias("y")).collect()
    assert [x["a"] for x in got] == [1.0, 0.0, 1.0] and [x["b"] for x in got] == [0.0, 0.0, 1.0] and [x["y"] for x in got] == [1.0, 0.0, 0.0]
    assert math.isclose(got[0]["n"], (1 + 1 / math.log2(3)) / 2) and got[1]["n"] == 0.0 and got[2]["n"] == 1.0
    s = spark.createDataFrame([(["s1_0", "s2_1", "s1_3"],)], "r array<string>").select(metrics.sessions("r").alias("s")).first()
    assert s["s"] == ["s1", "s2"]


def test_stats(spark):
    s = state_of(spark, [("a", "one two"), ("b", "three", {"layer": L1, "type": "event", "workspace": "v"})], [("a", "r", "b")])
    r = stats.stats(s).first()
    assert r["total_memories"] == 2 and r["by_layer"] == {L1: 1, L2: 1} and r["by_type"] == {"event": 1, "fact": 1} and r["edges"] == 1 and r["workspaces"] == ["default", "v"] and r["avg_tokens_per_memory"] == 1.5
    assert stats.stats(MemoryState.empty(spark)).first()["total_memories"] == 0


def test_snapshots_and_lock(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = state_of(spark, [("a", "x")])
    assert store.load(spark, root).memories.count() == 0
    assert store.commit(s, root) == 1 and store.commit(store.load(spark, root), root) == 2
    assert ids(store.load(spark, root).memories) == ["a"] and store.load(spark, root, 1).memories.count() == 1
    with store.writer(spark, root), pytest.raises(store.IndexLocked):
        store.commit(s, root)


def test_datasets(spark, tmp_path):
    q = [{"question_id": "q", "question_type": "t", "question": "?", "answer": "!", "question_date": "d", "haystack_session_ids": ["s2", "s1"], "haystack_dates": ["2024", "2023"], "haystack_sessions": [[{"role": "user", "content": "a", "has_answer": True}], [{"role": "user", "content": "b"}]], "answer_session_ids": ["s2"]}]
    (tmp_path / "q.json").write_text(json.dumps(q, indent=1))
    t = datasets.haystack_turns(datasets.json_array(spark, f"file://{tmp_path}/q.json"))
    assert [(r["session_id"], r["turn_idx"], r["has_answer"]) for r in t.collect()] == [("s1", 0, False), ("s2", 0, True)]
    assert metrics.gold_turns(t).first()["gold"] == ["s2_0"]
    (tmp_path / "src" / ".git").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / ".git" / "b.py").write_text("x = 1\n")
    tree = datasets.source_tree(spark, f"file://{tmp_path}/src", "w").collect()
    assert [(r["path"], r["content"]) for r in tree] == [("a.py", "x = 1\n")]
    assert datasets.markdown(spark.createDataFrame([(1,)], "n int"), "T").startswith("# T\n\n| n |")


def test_engine(spark, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/m", Config(dim=DIM))
    assert e.remember("ok", 1.0).first()["action"] == "drop"
    e.remember("auth uses JWT with 24h expiry", 2.0)
    e.remember("tokens rotate weekly", 3.0, layer="L5_mental")
    e.record_event("u", "fix login", 4.0, outcome="success")
    hits = e.recall("jwt expiry", 5.0).collect()
    assert hits[0]["content"] == "auth uses JWT with 24h expiry"
    assert e.stats().first()["by_layer"] == {L1: 1, L2: 2}
    assert e.state.memories.agg(F.sum("access_count")).first()[0] == len(hits)
    fact = e.list().where(F.col("content").contains("JWT")).first()["id"]
    e.forget(fact)
    assert e.list().count() == 2


def test_layered_config():
    c = Config.layered({"dim": 8, "recall": {"graph_hops": 3}}, {"recall": {"min_hits": 1}, "noise_words": ["hm"]})
    assert c.dim == 8 and c.recall.graph_hops == 3 and c.recall.min_hits == 1 and c.noise_words == ("hm",) and c.recall.top_k_tier1 == 8


# --- streams


def test_streams(spark, tmp_path):
    rows = [("w", "c", "1", 0.0), ("w", "c", "2", 50.0), ("w", "c", "3", 120.0), ("w", "d", "4", 60.0)]
    spark.createDataFrame(rows, "workspace string, content string, id string, created_at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("workspace string, content string, id string, created_at double").parquet(f"{tmp_path}/in")
    out = []
    w = streaming.deduplicated_exact(s, 100.0).writeStream.foreachBatch(lambda b, i: out.extend(r["id"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    w.awaitTermination()
    assert sorted(out) == ["1", "3", "4"]
    seen = []
    streaming.Worker(lambda b, i: seen.append(b.count())).once(s, f"{tmp_path}/c2")
    assert seen == [4]
    with pytest.raises(Exception):
        streaming.Worker(lambda b, i: 1 / 0).once(s, f"{tmp_path}/c3")
    late, early = streaming.after_mark(spark.createDataFrame(rows, "workspace string, content string, id string, created_at double"), 55.0)
    assert late.count() == 2 and early.count() == 2


@pytest.mark.parametrize("links", [1, 5, 1 << 20, (1 << 20) + 1, 3_000_000, 10**9])
def test_chain_rounds_follow_the_links(links):
    """Twenty rounds reach 2^20 hops only."""
    assert 2 ** graph.doubling_rounds(links) > links and graph.doubling_rounds(links) <= np.log2(links) + 2
