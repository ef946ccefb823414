"""Exact heavy hitters in bounded memory: a count-min sketch summed over tasks tells which keys may
pass a floor, a second pass counts just those. No key at or above the floor is lost, and at most
(all counts / floor) keys, plus few false alarms that the second pass removes, are ever gathered."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
SLICE = 1 << 14


def _cells(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def heavy(rows: DataFrame, keys_of, floor) -> tuple[dict[int, tuple[int, int]], int, int]:
    """({key: (count, tag)}, rows, total) of the keys whose count is ``floor(rows, total)`` or more.

    ``keys_of(texts)`` gives for each batch of texts (keys u64, counts, tags u64) arrays, a tag being a
    function of its key; ``rows`` has one column, text.
    """

    def sketch(batches):
        cells, n, total = np.zeros(1 << BITS, np.int64), 0, 0
        for pdf in batches:
            for keys, counts, _ in keys_of(pdf["text"].tolist()):
                cells += np.bincount(_cells(keys), counts, minlength=1 << BITS).astype(np.int64)
                total += int(np.sum(counts))
            n += len(pdf)
        if n:
            used = [k for k in range(0, 1 << BITS, SLICE) if cells[k : k + SLICE].any()]
            yield pd.DataFrame({"slice": [-1, *used], "cells": [np.array([n, total], "<i8").tobytes(), *[cells[k : k + SLICE].astype("<i8").tobytes() for k in used]]})

    def add(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for pdf in pdfs:
            for c in pdf["cells"]:
                v = np.frombuffer(c, "<i8")
                out = v.copy() if out is None else out + v
        yield pd.DataFrame({"slice": [int(key[0])], "cells": [out.tobytes()]})

    got = rows.mapInPandas(sketch, "slice int, cells binary").groupBy("slice").applyInPandas(add, "slice int, cells binary").collect()
    sums = {r["slice"]: np.frombuffer(r["cells"], "<i8") for r in got}
    n, total = (int(x) for x in sums.pop(-1, (0, 0)))
    least = floor(n, total)
    may = np.zeros(1 << BITS, bool)
    for k, v in sums.items():
        may[k : k + SLICE] = v >= least
    shared = rows.sparkSession.sparkContext.broadcast(may)

    def count(batches):
        sums: dict[tuple[int, int], int] = {}

        def rows_of(d):
            pairs = np.array(list(d), np.uint64).reshape(-1, 2).astype(np.int64)
            return pd.DataFrame({"key": pairs[:, 0], "tag": pairs[:, 1], "n": np.array(list(d.values()), np.int64)})

        for pdf in batches:
            for keys, counts, tags in keys_of(pdf["text"].tolist()):
                hit = shared.value[_cells(keys)]
                for k, t, c in zip(keys[hit].tolist(), tags[hit].tolist(), counts[hit].tolist()):
                    sums[k, t] = sums.get((k, t), 0) + c
            if len(sums) > 500_000:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    exact = rows.mapInPandas(count, "key long, tag long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.min("tag").alias("tag")).where(F.col("n") >= least)
    found = exact.collect()  # at most total / least rows
    whole = (1 << 64) - 1
    return {r["key"] & whole: (r["n"], r["tag"] & whole) for r in found}, n, total
