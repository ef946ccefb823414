"""Queries against their SQL where keys repeat, and operators whose groups grow."""

import duckdb
from pyspark.sql import functions as F

from memspark.plans.queries import ORACLE, QUERIES


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in sorted(p.stem for p in d.glob("*.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(d)).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def pages(spark, d):
    rows = [(k, f"http://a.org/{k % 4}", "\n".join(f"line {k} {j}" for j in range(30 * (k % 5)))) for k in range(24)]
    spark.createDataFrame([*rows, (24, "http://a.org/none", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")


def test_manifest_of_repeated_urls(spark, tmp_path):
    pages(spark, tmp_path)
    same_as_sql(spark, tmp_path, "file_manifest_diff")


def test_summaries_of_repeated_urls(spark, tmp_path):
    pages(spark, tmp_path)
    same_as_sql(spark, tmp_path, "file_summary")


def test_expiry_calls_a_bucket_once(spark, tmp_path):
    """Many ids in few groups of state: an id's later row counts, times at the watermark wait, state holds buckets."""
    from memspark import streaming

    for k, rows in enumerate([[(f"i{j}", 10, 20 + j) for j in range(300)], [(f"i{j}", 100, 1000 + j) for j in range(0, 300, 3)], [("late", 200, 5000)]]):
        df = spark.createDataFrame(rows, "id string, c long, e long").selectExpr("id", "timestamp_seconds(c) AS created_at", "timestamp_seconds(e) AS expires_at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id string, created_at timestamp, expires_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    q = streaming.expiring(s, buckets=5).writeStream.outputMode("append").foreachBatch(lambda df, i: got.extend((r["id"], int(r["e"])) for r in df.selectExpr("id", "unix_seconds(expires_at) AS e").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == sorted((f"i{j}", 20 + j) for j in range(300) if j % 3 and 20 + j < 200)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) <= 5


def test_top_k_within_holds_few_vectors(spark, monkeypatch):
    """Vectors are met a few at a time, ties and null keys included."""
    import numpy as np

    from memspark.operators import search

    r = np.random.default_rng(2)
    rows = [(None if j % 5 == 4 else f"w{j % 5}", f"v{j:03d}", [float(x) for x in r.integers(-2, 3, 4)]) for j in range(400)]
    v = spark.createDataFrame([*rows, ("w0", "none", None), ("w0", "short", [1.0])], "workspace string, id string, embedding array<double>")
    q = v.where("id like 'v%7'").select("workspace", F.col("id").alias("query_id"), "embedding")

    def found():
        return {(x["workspace"], x["query_id"], x["rank"]): round(x["similarity"], 5) + 0.0 for x in search.top_k_within(v, q, 6).collect()}

    whole = found()
    for name, n in (("MEET", 20), ("HELD", 50), ("ASKED", 3), ("BLOCK", 11)):
        monkeypatch.setattr(search, name, n)
    assert found() == whole
    unit = {i: (w, np.array(e) / (np.linalg.norm(e) or 1)) for w, i, e in rows}
    for i in [x for x in unit if x.endswith("7")]:
        best = sorted((round(float(unit[i][1] @ e), 5) for w, e in unit.values() if w == unit[i][0]), reverse=True)[:6]
        assert [whole[unit[i][0], i, n + 1] for n in range(6)] == [x + 0.0 for x in best]


def test_embedding_reads_text(spark):
    """The worker's features are those of the Column function, and only the text travels."""
    from memspark.functions import hashing, text

    odd = ["", "getHTTPResponse_code(x1, Y22);", "__ a_b ABCd", "été Straße ſ İ", "a.b:[c]{d}", None, "X" * 50, "x\ny\tz 12ab34CD"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    for r in df.select("t", text.features("t").alias("f"), hashing.hash_embed("t", 16).alias("e")).collect():
        assert hashing.features(r["t"]) == (r["f"] or [])
        assert r["e"] == hashing.hash_vector(r["f"] or [], 16).tolist()


def test_nearest_cells_in_parts(monkeypatch):
    import numpy as np

    from memspark.operators import ann

    r = np.random.default_rng(4)
    units, centres = r.normal(size=(100, 5)).astype("f4"), r.normal(size=(9, 5)).astype("f4")
    want = np.argsort(-(units.astype(float) @ centres.T.astype(float)), axis=1, kind="stable")
    monkeypatch.setattr(ann, "CHUNK", 7 * 9)
    for n in (1, 3, 9, 20):
        assert (ann.nearest_cells(units, centres, n) == want[:, :n]).all()


def test_bigrams(spark, tmp_path):
    rows = [(1, "getValue of theX, theX", "en", "a", 1), (2, "one", "en", "a", 1), (3, None, "en", "a", 1), (4, "theX theX", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, tmp_path, "bigram_features")


def test_loose_vectors_only_are_compared_again(spark, monkeypatch):
    """At a low threshold nearly all vectors of a key are one component after the first blocks; what is sent to cells stays near linear."""
    import numpy as np

    from memspark.operators import graph

    monkeypatch.setattr(graph, "TASK_VECTORS", 60)
    r = np.random.default_rng(6)
    rows = [("a", k, [float(x) for x in r.normal(size=12)]) for k in range(1200)]
    asked, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, kind: [x := real(df, kind), asked.append((kind, x.count()))][0])
    got = {x["id"]: x["component"] for x in graph.similar_components(spark.createDataFrame(rows, "workspace string, id int, embedding array<double>"), 0.5).collect()}
    m = np.array([v for _, _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near, label = m @ m.T >= 0.5, np.arange(1200)
    while True:
        new = np.where(near, label[None, :], 1200).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert got == dict(enumerate(label.tolist()))
    assert sum(n for kind, n in asked if kind in ("visits", "cells")) < 4 * 1200  # before: each vector visited half of 20 cells
