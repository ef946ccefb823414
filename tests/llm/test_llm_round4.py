"""Mixing, phrase mining and suffix-array deduplication: results that come through the operator, and steps whose cost is bounded."""

import os
import sys

import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from memspark.llm import decontam, mixing, neardup, phrases, quality, suffixdedup, tokenbin
from memspark.llm.queries import tokenizer_path


def test_mixing_query_reads_the_stream(spark, monkeypatch):
    """Words, copies and positions are those of the training stream, not of the plan for it."""
    rows = [(k, f"w{k} " * (k % 7 * 60 + 1), f"s{k % 4}") for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, None), (1, rows[1][1], "s1")], "doc_id long, text string, source string")
    whole = sorted(map(repr, mixing.query(docs).collect()))
    real = mixing.training_stream
    monkeypatch.setattr(mixing, "training_stream", lambda assigned, *c: real(assigned, *c).where("epoch = 0"))
    first = mixing.query(docs).collect()
    assert len(first) == len(whole) == 62 and sorted(map(repr, first)) != whole
    assert all(x["copies"] <= 1 and x["taken"] == x["copies"] * x["size"] and (x["first_position"] is None) == (x["copies"] == 0) for x in first)


def test_bucket_sums_are_one_job(spark, monkeypatch):
    """Blocks are summed by the tasks of one job that writes them; the driver reads what they wrote."""
    monkeypatch.setattr(phrases, "SLICE", 7)
    rows = [(b, bytearray(np.array([1, 2, 2, b + 9], "<u2").tobytes()), bytearray([3, 4, 200, 1])) for b in (0, 1, 5, 3) for _ in range(3)]
    written, real = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, kind, **o: written.append(kind) or real(df, kind, **o))
    packed = spark.createDataFrame(rows, "block int, places binary, counts binary")
    bits = np.unpackbits(np.frombuffer(phrases.bitmap(packed, 19, 9).value, np.uint8), bitorder="little")
    assert written == ["phrasemarks"]
    assert sorted(np.flatnonzero(bits).tolist()) == sorted(b * phrases.WIDTH + p for b in (0, 1, 5, 3) for p in (1, 2))


def test_suffix_arrays_hold_a_shard(spark, monkeypatch):
    """Groups of grams are worked off a shard at a time: no call gets more than a shard and its last group."""
    r = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    shared = [word(500) for _ in range(30)]
    texts = [(k, word(300) + shared[k % 30] + word(300)) for k in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(repr, suffixdedup.query(docs).collect()))
    here = f"{os.environ.get('TMPDIR', '/tmp')}/shards-{os.getpid()}"
    real = suffixdedup.repeated_windows

    def watched(slices, *rest):
        with open(here, "a") as f:
            f.write(f"{sum(map(len, slices))}\n")
        return real(slices, *rest)

    monkeypatch.setattr(suffixdedup, "SHARD", 4000)
    monkeypatch.setattr(suffixdedup, "repeated_windows", watched)
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(suffixdedup)
    try:
        got = sorted(map(repr, suffixdedup.query(docs).collect()))
    finally:
        pickle.unregister_pickle_by_value(suffixdedup)
    assert got == want
    assert max(int(x) for x in open(here)) < 4000 + 4 * 1000


def test_workers_remember_for_one_operator(spark):
    """The stages of the pipeline run in the same Python workers one after another; a stage finds no memo of those before it."""
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), x -> concat('w', id * 7 + x))) AS text")
    items = spark.createDataFrame([(1, " ".join(f"w{x}" for x in range(20)))], "item_id long, text string")

    def held(batches):
        for _ in batches:
            yield pd.DataFrame([(os.getpid(), len(tokenbin.Encoder._loaded), len(neardup._words), len(decontam._tokens))], columns=["pid", "a", "b", "c"])

    def workers():
        return {x["pid"]: (x["a"], x["b"], x["c"]) for x in spark.range(0, 8, 1, 8).mapInPandas(held, "pid long, a long, b long, c long").collect()}

    def last(k, done):
        found = workers().values()
        assert any(x[k] for x in found) and all(sum(map(bool, x)) <= 1 for x in found), (done, found)

    for done in (1, 2):
        tokenbin.query(docs, tokenizer_path()).collect()
        last(0, done)
        neardup.query(docs).collect()
        last(1, done)
        decontam.clean(docs, items).collect()
        last(2, done)
    quality.query(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert any(not any(x) for x in workers().values())
