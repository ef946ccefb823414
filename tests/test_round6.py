"""Consolidation of whole tables, and the walk from anchors in bounded space."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_round4 import same_as_sql

from memspark.functions.hashing import hash_hex
from memspark.operators import folds, search
from memspark.plans.queries import QUERIES
from memspark.schema import L1, L2, Config, MemoryState


def events(spark, d, n=2600):
    r = np.random.default_rng(3)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=int(k // 2)), int(r.integers(0, 90)), str(r.choice(["view", "click", "error"])), 1.0, '{"k": %d}' % r.integers(0, 3)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")


def in_order(rows, near, threshold, classify=None):
    """rows: (workspace, id, layer, created_at, content, hash, vector) -> {episode: (action, n_similar, new, target)}, one after another."""
    out = {}
    for ws in {r[0] for r in rows}:
        held = {r[1]: (r[6], r[2] == L2, r[5], r[4]) for r in rows if r[0] == ws and r[6] is not None}
        for _, i, _, _, content, _, v in sorted((r for r in rows if r[0] == ws and r[2] == L1 and r[6] is not None), key=lambda r: (r[3], r[1])):
            sims = sorted((-round(cosine(v, w), 9), j) for j, (w, *_) in held.items())[:near]
            similar = [(-s, j) for s, j in sims if -s >= 0.1 and held[j][1]]
            own = hash_hex(content.encode())
            if classify:
                action, new_text = classify(content, [held[j][3] for _, j in similar])
            else:
                action, new_text = folds.decide(own, [(s, held[j][2], "") for s, j in similar], threshold), content
            new = target = None
            if action == "ADD":
                new, new_text = hash_hex(f"add\x00{i}".encode()), content
            elif action in ("UPDATE", "DELETE") and similar:
                target = similar[0][1]
                del held[target]
                new = hash_hex(f"update\x00{i}\x00{target}".encode()) if action == "UPDATE" else None
            if new:
                held[new] = (v, True, hash_hex((new_text or content).encode()), new_text or content)
            out[i] = action, len(similar), new, target
    return out


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


@pytest.mark.parametrize("judged", [False, True])
def test_consolidation_in_order(spark, monkeypatch, judged):
    """Every episode of a workspace, past the pass of 500: decisions as one after another, ties, null workspaces and zero vectors included."""

    def picky(content, similar):  # by what it is shown
        return [("ADD", ""), ("UPDATE", content + "!"), ("DELETE", ""), ("NOOP", ""), ("UPDATE", "")][(len(content) + len(similar) + len("".join(similar))) % 5]

    classify = picky if judged else None
    for name, n in (("NUMBERS", 600), ("CHUNK", 50), ("ASKED", 7), ("MANY", 1)):
        monkeypatch.setattr(search, name, n)
    r = np.random.default_rng(5)
    rows = []
    for k in range(900):
        ws = ["a", "a", "a", "b", None][k % 5]
        layer = L2 if k % 9 == 4 else L1
        i = f"{'0123456789abcdefgx'[k % 18]}-{k}"
        content = f"text {r.integers(0, 40)}"
        v = None if k % 50 == 7 else [float(x) for x in r.integers(-2, 3, 4)]
        rows.append((ws, i, layer, float(k // 3), content, hash_hex(content.encode()), v))
    m = spark.createDataFrame([(*x, "{}", "") for x in rows], "workspace string, id string, layer string, created_at double, content string, content_hash string, embedding array<float>, metadata string, summary string")
    log = folds.consolidation_log(MemoryState.empty(spark, memories=m), Config(dim=4), classify=classify, cap=None).collect()
    want = in_order(rows, Config().min_episodes_to_trigger + 5, Config().dedup_similarity, classify)
    assert {x["episode_id"]: (x["action"], x["n_similar"], x["new_id"], x["target_id"]) for x in log} == want
    assert len({x[0] for x in want.values()}) >= 3


def test_consolidate_actions_reads_every_event(spark, tmp_path):
    events(spark, tmp_path)
    spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["consolidate_actions"](spark, str(tmp_path))
    assert got.count() == 2600 and got.agg(F.max("place")).first()[0] > 500


def test_decisions_of_every_event(spark, tmp_path):
    events(spark, tmp_path)
    same_as_sql(spark, tmp_path, "consolidate_decisions")
    assert QUERIES["consolidate_decisions"](spark, str(tmp_path)).count() == 2600


def test_state_after_every_event(spark, tmp_path):
    events(spark, tmp_path)
    same_as_sql(spark, tmp_path, "consolidate_state")


def test_clone_keeps_nearest_summary(spark):
    """Past the pass of 500: the live fact at the end of a chain of updates has the last summary that was told."""
    r = [(f"x{k:03d}", L1, "w", "event", f"text {k}", f"told {k}" if k in (3, 590) else "", float(k)) for k in range(600)]
    m = spark.createDataFrame(r, "id string, layer string, workspace string, type string, content string, summary string, created_at double")
    from memspark.operators import layers

    state = MemoryState.empty(spark, memories=layers.memory_rows(m, 50.0).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")))
    after, log = folds.consolidate(state, 50.0, lambda c: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), Config(dim=2), cap=None)
    live = after.memories.where("layer = 'L2_semantic' and embedding is not null").collect()
    assert [(x["content"], x["summary"]) for x in live] == [("text 599", "told 590")]
    assert {x["action"]: x["count"] for x in log.groupBy("action").count().collect()} == {"ADD": 1, "UPDATE": 599}


def shop(spark, d, orders=301, parts=40, suppliers=60):
    r = np.random.default_rng(8)
    ok = [k for k in range(orders) if k % 7 != 3]
    spark.createDataFrame([(k, int(r.integers(0, 30))) for k in ok], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(parts)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k,) for k in range(suppliers)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    lines = [(k, j, int(r.integers(0, parts + 3)), float(r.integers(1, 51)), str(r.choice(["R", "N", "A"]))) for k in ok for j in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_walk_keeps_what_it_returns_only(spark, tmp_path, monkeypatch, hops):
    """The walk equals its SQL at any depth; of the tables written on the way those are left that the result reads."""
    from pathlib import Path

    from memspark.operators import recall
    from memspark.plans import extra, queries

    shop(spark, tmp_path)
    shared, real = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://").removeprefix("file:")), recall.expand
    monkeypatch.setattr(recall, "expand", lambda state, anchors, _: real(state, anchors, hops))
    monkeypatch.setitem(queries.ORACLE, "tier2_walk", extra._walk_sql(3, hops))
    before = set(shared.iterdir())
    same_as_sql(spark, tmp_path, "tier2_walk")
    left = sorted(p.name.split("-")[0] for p in set(shared.iterdir()) - before)
    assert left == ["expanded", "files", "paths"]


def test_written_removes_its_shuffle(spark):
    from memspark.operators import graph

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    t = graph.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    assert t.count() == 7 and tracker.shuffleStatuses().size() <= held + 1  # count() leaves one of its own
    graph.forget(t)
