"""Inverted-file search, the graph walk by joins, and streams that lose nothing."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark import streaming
from memspark.operators import ann, search


def vectors(spark, n=600, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    rows = [(f"v{k:04d}", [float(x) for x in centres[k % 12] + r.normal(0, 0.3, dim)]) for k in range(n)]
    rows += [(f"copy{k}", [1.0] * dim) for k in range(60)] + [(f"zero{k}", [0.0] * dim) for k in range(5)] + [("null", None), ("short", [1.0, 2.0])]
    return spark.createDataFrame(rows, "id string, embedding array<double>"), rows


def brute(rows, q, k, dim=8):
    q = np.asarray(q, np.float32)
    nq = np.linalg.norm(q)
    out = []
    for i, v in rows:
        if v is None or len(v) != dim:
            continue
        v = np.asarray(v, np.float32)
        nv = np.linalg.norm(v)
        out.append((-(round(float(q @ v / nq / nv), 5) if nq and nv else 0.0), i))
    return [i for _, i in sorted(out)[:k]]


def test_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)  # cells and their queries are split
    v, rows = vectors(spark)
    asked = [r for r in rows if r[1] is not None and len(r[1]) == 8][::7] + [("away", [-1.0] * 8), ("nil", [0.0] * 8)]
    q = spark.createDataFrame(asked + [("other", [1.0])], "query_id string, embedding array<double>")
    index = ann.build(v, dim=8)
    assert index.filed.count() == 660 and index.zeros.count() == 5
    exact = collections.defaultdict(list)
    for r in ann.top_k(index, q, 10, probes=len(index.centres)).orderBy("rank").collect():
        exact[r["query_id"]].append(r["id"])
    for name, x in asked:
        want = brute(rows, x, 10)
        assert len(exact[name]) == 10 and (exact[name] == want or name != "nil")
    assert "other" not in exact and exact["nil"] == sorted(i for i, x in rows if x is not None and len(x) == 8)[:10]
    best = search.top_k(v.where("size(embedding) = 8 and id not like 'zero%'"), q.where("query_id not in ('nil', 'other')"), 10)
    some = ann.top_k(index, q.where("query_id not in ('nil', 'other', 'away')"), 10, ann.calibrated(index, 10))
    recall = ann.recall_at(some, best.where("query_id <> 'away'"), 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_zero_vectors_stand_between(spark):
    """The rule of the reference's degenerate cases: +x, +y, -x and zero."""
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id int, embedding array<double>")
    index = ann.build(v)
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in ann.top_k(index, q, 3, probes=9).collect()}
    assert [got[1, k][0] for k in (1, 2, 3)] == ["a", "b", "z"] and [got[2, k] for k in (1, 2, 3)] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
    none = ann.build(v.where("false"))
    assert ann.top_k(none, q, 3).count() == 0
    with pytest.raises(ValueError):
        ann.top_k(index, q, 0)


# --- streams


def batches(spark, tmp_path, sizes):
    """A stream of one file a batch."""
    at = 0
    for k, n in enumerate(sizes):
        spark.range(at, at + n).withColumn("k", F.lit(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        at += n
    return spark.readStream.schema("id long, k int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("every", [1, 3])
def test_worker_loses_nothing(spark, tmp_path, every):
    seen, calls = [], []

    def step(df, batch_id):
        calls.append(batch_id)
        if len(calls) in (1, 2):
            raise RuntimeError("injected")
        seen.extend(r["id"] for r in df.collect())

    s = batches(spark, tmp_path, [5, 1, 7, 3, 2, 4, 6])
    q = streaming.Worker(step, interval_s=0, max_errors=None, every=every).start(s, f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    streaming.Worker(step, every=every).drain(spark, f"{tmp_path}/c-pending")
    assert sorted(seen) == list(range(28)) and len(calls) >= 3


def test_worker_ends_and_takes_up_again(spark, tmp_path):
    """The stream ends after ``max_errors``; rows of all its batches reach the next worker."""
    s = batches(spark, tmp_path, [3, 3, 3, 3])
    bad = streaming.Worker(lambda df, i: 1 / 0, interval_s=0, max_errors=2).start(s, f"{tmp_path}/c")
    with pytest.raises(Exception):
        bad.processAllAvailable()
    seen = []
    streaming.Worker(lambda df, i: seen.extend(r["id"] for r in df.collect())).once(s, f"{tmp_path}/c")
    assert sorted(seen) == list(range(12))
    streaming.Worker(lambda df, i: seen.append(-1)).once(s, f"{tmp_path}/c")
    assert -1 not in seen


def test_once_flushes_what_every_left(spark, tmp_path):
    seen = []
    streaming.Worker(lambda df, i: seen.append((i, df.count())), every=3).once(batches(spark, tmp_path, [1] * 7), f"{tmp_path}/c")
    assert sum(n for _, n in seen) == 7 and [n for _, n in seen] == [3, 3, 1]


def test_mark_counts(spark, tmp_path):
    s = batches(spark, tmp_path, [5, 5, 5]).withColumn("created_at", F.when(F.col("id") != 3, F.col("id").cast("double")))
    marks, rows = streaming.MarkCounts(6.0), []
    q = marks.passed(s).writeStream.foreachBatch(lambda df, i: rows.extend(r["id"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(rows) == list(range(7, 15)) and marks.of(q) == {"passed": 8, "late": 7, "highest": 14.0}


def test_expiring_intents(spark, tmp_path):
    for k, rows in enumerate([[("a", 10, 30), ("b", 10, 1000), ("c", 11, 5)], [("a", 20, 40), ("d", 100, 120)], [("e", 500, 5000)], [("f", 501, 6000)]]):
        df = spark.createDataFrame(rows, "id string, c long, e long").selectExpr("id", "timestamp_seconds(c) AS created_at", "timestamp_seconds(e) AS expires_at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id string, created_at timestamp, expires_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    q = streaming.expiring(s).writeStream.outputMode("append").foreachBatch(lambda df, i: got.extend((r["id"], int(r["e"])) for r in df.selectExpr("id", "unix_seconds(expires_at) AS e").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == [("a", 40), ("c", 5), ("d", 120)]
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state[-1] == 3 and len(state) > 1  # b, e and f are still to come


# --- components of similar vectors


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.2])
def test_similar_components(spark, monkeypatch, threshold):
    """Cells, visits and blocks find what all pairs would."""
    from memspark.operators import graph

    monkeypatch.setattr(graph, "TASK_VECTORS", 12)
    r = np.random.default_rng(3)
    rows = [("a" if k % 3 else None, k, [float(x) for x in r.normal(size=3)]) for k in range(150)]
    rows += [("a", 900 + k, rows[1][2]) for k in range(30)] + [("b", 800, [0.0] * 3), ("b", 801, [0.0] * 3), ("b", 802, [1.0, 0.0, 0.0]), ("a", 803, None), ("c", 804, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "workspace string, id int, embedding array<double>")
    got = {r["id"]: r["component"] for r in graph.similar_components(df, threshold).collect()}
    held = [x for x in rows if x[2] is not None]
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for _, i, v in held}
    parent = {i: i for _, i, _ in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (wx, i, vx) in enumerate(held):
        for wy, j, vy in held[:x]:
            if wx == wy and (vx == vy or float(unit[i] @ unit[j]) >= threshold):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for _, i, _ in held}


def test_update_chain_keeps_its_root(spark):
    """Twenty updates of one fact: what the last clone keeps comes from the first row, its summary from the nearest that has one."""
    from memspark.operators import folds, layers
    from memspark.schema import Config, MemoryState

    e = spark.createDataFrame([(f"x{k:02d}", "w", f"u{k}", "act", "", "ok", float(k), 0.0, 0) for k in range(20)], "id string, workspace string, agent string, action string, observation string, outcome string, created_at double, last_access_at double, access_count int")
    memories = layers.episodes(e, 50.0).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")).withColumn("summary", F.when(F.col("id") == "x04", "told").otherwise(""))
    state = MemoryState.empty(spark, memories=memories)
    after, log = folds.consolidate(state, 50.0, lambda c: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), Config(dim=2))
    actions = [r["action"] for r in log.orderBy("place").collect()]
    # seven of the eight nearest are episodes once there are so many; facts come first as their ids are hex
    assert actions[0] == "ADD" and actions.count("UPDATE") + actions.count("ADD") == 20
    live = after.memories.where("layer = 'L2_semantic' and embedding is not null")
    assert live.count() == actions.count("ADD")
    if actions.count("ADD") == 1:
        assert live.first()["summary"] == "told"
