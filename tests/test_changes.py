"""Components that follow changes, source trees as a data source, records of unsure shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import clustering, cycle, graph
from memspark.operators.clustering import Clustering


def brute(rows, threshold):
    """id -> component of rows (key, id, vector)."""
    parent = {i: i for _, i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {}
    for _, i, v in rows:
        n = np.linalg.norm(v)
        unit[i] = np.asarray(v) / n if n else np.zeros(len(v))
    for k1, i, _ in rows:
        for k2, j, _ in rows:
            both_zero = not unit[i].any() and not unit[j].any()  # equal vectors are similar
            if i < j and k1 == k2 and (both_zero or unit[i] @ unit[j] >= threshold):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for _, i, _ in rows}


def test_components_follow_changes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TASK_VECTORS", 40)
    monkeypatch.setattr(graph, "TASK_VECTORS", 40)
    r = np.random.default_rng(3)
    centres = r.normal(size=(25, 6))
    rows = [(None if k % 11 == 0 else f"w{k % 3}", f"v{k:03d}", [float(x) for x in centres[k % 25] + r.normal(0, 0.35, 6)]) for k in range(150)]
    rows.insert(0, ("w0", "zero1", [0.0] * 6))
    rows += [("w0", "zero2", [0.0] * 6), ("w1", "copy1", rows[2][2]), ("w1", "copy2", rows[2][2])]
    df = lambda some: spark.createDataFrame(some + [("w0", "null", None)], "workspace string, id string, embedding array<double>")
    steps = [rows[:90], rows[:1] + rows[20:], [(k, i, v if i != "v100" else [-x for x in v]) for k, i, v in rows if i[-1] != "7"]]
    c = None
    for some in steps:
        c = Clustering.of(df(some), 0.9) if c is None else c.advance(df(some))
        got = {x["id"]: x["component"] for x in c.rows.collect()}
        assert got == brute(some, 0.9) and len(got) == c.rows.count()
    assert len(c.pivots) > 1 and Clustering.of(df([]), 0.9).advance(df(rows[:5])).rows.count() == 5


def test_forest_joins_what_is_connected():
    r = np.random.default_rng(1)
    for _ in range(50):
        hits = r.random((9, 7)) < 0.15
        links = clustering.bipartite_forest(hits)
        assert len(links) < 16 and all(hits[a, b] for a, b in links)

        def parts(pairs):
            label = {("a", x): ("a", x) for x in range(9)} | {("b", x): ("b", x) for x in range(7)}
            for _ in range(20):
                for a, b in pairs:
                    label["a", a] = label["b", b] = min(label["a", a], label["b", b])
            return label

        assert parts(links) == parts(list(zip(*map(list, np.nonzero(hits)))))


def test_source_tree(spark, tmp_path):
    import os

    from memspark.sources import datasets, tree

    spark.dataSource.register(tree.SourceTree)
    root = tmp_path / "src"
    files = {f"d{k % 9}/e{k % 4}/f{k}.py": f"x = {k}\n" for k in range(120)} | {"top.py": "é", "empty.py": "", ".git/a.py": "no", "d1/build/b.py": "no", "d1/x.lock.py": "no"}
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    rows.repartition(4).write.format("source_tree").mode("append").save(str(root))
    (root / "bad.py").write_bytes(b"a\xffb")
    os.symlink(tmp_path / "nowhere", root / "dangling.py")
    want = {p: c for p, c in files.items() if c != "no"} | {"bad.py": "a�b"}
    for splits in (1, 3, 1000):
        got = spark.read.format("source_tree").option("ignore", ".lock*").option("splits", splits).load(str(root)).collect()
        assert {r["path"]: r["content"] for r in got} == want and len(got) == len(want)
    assert {r["path"]: r["content"] for r in datasets.source_tree(spark, f"file://{root}", "w", (".lock*",)).collect()} == want
    for path in ("../x.py", "/x.py", "a//b", ""):
        with pytest.raises(Exception, match="not a path below the root"):
            spark.createDataFrame([(path, "")], "path string, content string").write.format("source_tree").mode("append").save(str(root))
    with pytest.raises(Exception, match="absent"):
        spark.read.format("source_tree").load(str(tmp_path / "absent")).collect()


def test_source_tree_deals_large_folders(tmp_path, monkeypatch):
    from memspark.sources import tree

    monkeypatch.setattr(tree, "FILES", 10)
    monkeypatch.setattr(tree, "BATCH_BYTES", 5)
    for k in range(57):
        (tmp_path / f"f{k:02d}").write_text("ab")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g").write_text("c")
    reader = tree.TreeReader({"path": str(tmp_path), "splits": "2"})
    parts = reader.partitions()
    got = [p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert len(parts) == 7 and sorted(got) == sorted([f"f{k:02d}" for k in range(57)] + ["sub/g"])


def test_source_tree_stream_takes_each_change_once(tmp_path):
    import os

    from memspark.sources import tree

    for k in range(20):
        (tmp_path / f"f{k:02d}").write_text("x")
        os.utime(tmp_path / f"f{k:02d}", (1000 + k, 1000 + k))
    reader = tree.TreeStreamReader({"path": str(tmp_path), "settle": "0"})
    seen, at = [], reader.initialOffset()
    for upto in (1004, 1004, 1011, 1100):
        end = {"upto": upto * 1_000_000}
        asked = lambda: [p for f in reader.partitions(at, end) for b in reader.read(f) for p in b.column("path").to_pylist()]  # noqa: E731, B023
        assert asked() == asked()
        seen += asked()
        at = end
    assert sorted(seen) == [f"f{k:02d}" for k in range(20)] and reader.latestOffset()["upto"] > at["upto"]


def test_records_of_unsure_shape(spark, tmp_path):
    from memspark.sources import records

    lines = ['{"a": 1, "b": [{"c": "x"}]}', '{"a": "7", "b": null}', '{"a": 1, "b": 3}', '{"b": []}', "[1]", "3", "null", "{", "", "  ", '{"a": null}', '{"a": "q"}', '{"a": 2, "more": {"b": 1}}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = records.shaped(records.json_values(spark, str(tmp_path / "x.jsonl")), "a long, b array<struct<c: string>>", ("a",))
    good, bad = records.split(rows)
    assert sorted((r["a"], r["b"] and [x["c"] for x in r["b"]]) for r in good.collect()) == [(1, ["x"]), (2, None), (7, None)]
    want = {lines[2]: "b does not fit", lines[3]: "a is missing", "[1]": "not an object", "3": "not an object", "null": "not an object", "{": "not JSON", lines[10]: "a is missing", lines[11]: "a does not fit"}
    assert {r["value"]: r["problem"] for r in bad.collect()} == want


def test_questions_and_bad_ones(spark, tmp_path):
    import json

    from memspark.sources import datasets, records

    turn = {"role": "user", "content": "hi", "has_answer": True}
    ok = {"question_id": "q1", "question": "?", "haystack_session_ids": ["s2", "s1"], "haystack_dates": ["2024-02", "2024-01"], "haystack_sessions": [[turn], [{"role": "user", "content": "yo"}]]}
    some = [ok, ok | {"question_id": "q2", "haystack_session_ids": ["s1"]}, ok | {"question_id": None}, ok | {"haystack_sessions": "none"}, 5]
    (tmp_path / "q.json").write_text(json.dumps(some, indent=1))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, some)))
    for good, bad in (records.read_questions(spark, str(tmp_path / "q.json")), records.read_questions(spark, str(tmp_path / "q.jsonl"), array=False)):
        turns = datasets.haystack_turns(good).collect()
        assert [(t["session_id"], t["content"], t["has_answer"]) for t in turns] == [("s1", "yo", False), ("s2", "hi", True)]
        assert sorted(r["problem"] for r in bad.collect()) == ["haystack_sessions does not fit", "not an object", "question_id is missing", "sessions and ids differ in number"]
    (tmp_path / "cut.json").write_text("[{")
    good, bad = records.read_questions(spark, str(tmp_path / "cut.json"))
    assert good.count() == 0 and [r["problem"] for r in bad.collect()] == ["not JSON"]
