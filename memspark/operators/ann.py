"""Approximate cosine top-k: an inverted-file index over unit vectors.

``build`` learns cells by distributed spherical k-means (every round sums the vectors of each cell in the tasks; cells x
dim numbers go through the driver, ``MAX_CELLS`` at most) and files each vector under its nearest centre. A search asks the
``probes`` nearest cells of each query, compares there exactly, and merges the k best. With as many probes as
cells the result is exact. All rows are indexed, nothing is sampled. How many probes a recall takes depends on the data:
``calibrated`` measures it on ``SAMPLE`` of the indexed vectors.

Cells are as uneven as the data (copies all share one), so a cell's vectors are dealt over parts of about
``PART`` vectors and its queries over parts of as many; what meets in a task is two bounded matrices.

Vectors of norm zero have no direction: they are kept beside the cells and join every result at similarity 0, of
which only the k least ids can matter. A query of norm zero gets the first k ids at similarity 0, by bytes for strings. Null
vectors, vectors of another dimension than the index and such queries find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, search

MAX_CELLS = 4096
ROUNDS = 6
PART = 4096
#: Vectors on which the number of probes is measured.
SAMPLE = 256
#: Numbers in a matrix of vectors x cells, and rows of queries x cells in a frame.
CHUNK, FRAME = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Index:
    """centres: unit rows; filed: cell, part, id, embedding; zeros: id. Tables in the shared folder."""

    dim: int
    centres: np.ndarray
    filed: DataFrame
    zeros: DataFrame


def _norm2(c: str):
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def nearest_cells(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first; ties by number."""
    out = np.zeros((len(units), min(n, len(centres))), np.int64)
    wide, step = centres.T.astype(np.float64), max(1, CHUNK // max(1, len(centres)))
    for at in range(0, len(units), step):
        sims = units[at : at + step].astype(np.float64) @ wide
        out[at : at + step] = sims.argmax(axis=1)[:, None] if n == 1 else np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return out


def build(vectors: DataFrame, cells: int | None = None, rounds: int = ROUNDS, dim: int | None = None) -> Index:
    """vectors (id, embedding). cells: about the root of the rows by default."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    if dim is None:
        first = rows.agg(F.min_by(F.size("embedding"), "id")).first()[0]
        dim = first or 1
    rows = rows.where(F.size("embedding") == dim).withColumn("norm2", _norm2("embedding"))
    zeros = graph.written(rows.where("norm2 = 0").select("id"), "annzeros")
    rows = rows.where("norm2 > 0").drop("norm2")
    n = rows.count()
    cells = max(1, min(MAX_CELLS, cells or int(np.ceil(np.sqrt(n)))))
    # starting centres: distinct vectors in a pseudo-random order
    start = rows.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(cells).toPandas()
    centres = search._unit(search._matrix(start["embedding"], dim))
    if not n:
        return Index(dim, centres, graph.written(rows.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), "id", "embedding"), "annfiled"), zeros)
    for _ in range(rounds):

        def sums(batches, centres=centres):
            total, count = np.zeros(centres.shape, np.float64), np.zeros(len(centres), np.int64)
            for pdf in batches:
                m = search._unit(search._matrix(pdf["embedding"], dim))
                cell = nearest_cells(m, centres, 1)[:, 0] if len(m) else np.zeros(0, np.int64)
                np.add.at(total, cell, m)
                count += np.bincount(cell, minlength=len(centres))
            used = np.flatnonzero(count)
            if len(used):
                yield pd.DataFrame({"cell": used, "total": list(total[used])})

        got = rows.select("embedding").mapInPandas(sums, "cell long, total array<double>").groupBy("cell").agg(F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)]).alias("total")).toPandas()
        fresh = centres.copy()
        fresh[got["cell"].to_numpy()] = search._unit(np.array(got["total"].tolist(), np.float64).reshape(-1, dim))
        centres = fresh

    def file(batches):
        for pdf in batches:
            if len(pdf):
                m = search._unit(search._matrix(pdf["embedding"], dim))
                yield pdf.assign(cell=nearest_cells(m, centres, 1)[:, 0])

    kind = vectors.schema["id"].dataType.simpleString()
    filed = graph.written(rows.mapInPandas(file, f"id {kind}, embedding array<float>, cell long"), "anncells")
    parts = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = filed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "embedding")
    return Index(dim, centres, graph.written(dealt, "annfiled"), zeros)


def top_k(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """queries (query_id, embedding) -> query_id, id, similarity, rank: similarity down, then id."""
    if k < 1:
        raise ValueError("k is at least 1")
    if probes < 1:
        raise ValueError("probes is at least 1")
    q = queries.where(F.size("embedding") == index.dim).select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).withColumn("norm2", _norm2("embedding"))
    qkind, kind = queries.schema["query_id"].dataType.simpleString(), index.filed.schema["id"].dataType.simpleString()
    centres, dim = index.centres, index.dim

    def aim(batches):
        for pdf in batches:
            step = max(1, FRAME // min(probes, max(1, len(centres))))
            for at in range(0, len(pdf) if len(centres) else 0, step):
                some = pdf[at : at + step]
                cells = nearest_cells(search._unit(search._matrix(some["embedding"], dim)), centres, probes)
                yield pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), cells.shape[1]), "embedding": some["embedding"].repeat(cells.shape[1]).to_numpy(), "cell": cells.ravel()})

    aimed = q.where("norm2 > 0").select("query_id", "embedding").mapInPandas(aim, f"query_id {qkind}, embedding array<float>, cell long")
    shape = aimed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("qparts")).join(index.filed.groupBy("cell").agg(F.max("part").alias("last")), "cell")
    # a cell's queries are dealt over parts and sent to each part of its vectors, and these to each part of the queries
    asked = aimed.join(shape, "cell").select("cell", F.pmod(F.xxhash64("query_id"), F.col("qparts")).alias("qpart"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"), "query_id", "embedding")
    held = index.filed.join(shape.select("cell", "qparts"), "cell").select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts") - 1)).alias("qpart"), "id", "embedding")

    def best(key: tuple, vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "similarity": []})]
        if len(vs) and len(qs):
            ids, m, qm = vs["id"].to_numpy(), search._unit(search._matrix(vs["embedding"], dim)).astype(np.float64), search._unit(search._matrix(qs["embedding"], dim)).astype(np.float64)
            for at in range(0, len(qs), 256):
                sims = qm[at : at + 256] @ m.T
                cols = search._best(sims, ids, k)
                out.append(pd.DataFrame({"query_id": np.repeat(qs["query_id"].to_numpy()[at : at + 256], cols.shape[1]), "id": ids[cols].ravel(), "similarity": np.take_along_axis(sims, cols, 1).ravel()}))
        return pd.concat(out[1:] or out)

    near = held.groupBy("cell", "part", "qpart").cogroup(asked.groupBy("cell", "part", "qpart")).applyInPandas(best, f"query_id {qkind}, id {kind}, similarity double")
    # at similarity 0 only the k least ids can be among the best
    zero_ids = [r["id"] for r in index.zeros.orderBy("id").limit(k).collect()]
    found = near
    if zero_ids:
        at_zero = q.where("norm2 > 0").select("query_id", F.explode(F.array(*[F.lit(i).cast(kind) for i in zero_ids])).alias("id"), F.lit(0.0).alias("similarity"))
        found = found.unionByName(at_zero)
    first_ids = [r["id"] for r in index.filed.select("id").unionAll(index.zeros).orderBy("id").limit(k).collect()]
    if first_ids:
        found = found.unionByName(q.where("norm2 = 0").select("query_id", F.explode(F.array(*[F.lit(i).cast(kind) for i in first_ids])).alias("id"), F.lit(0.0).alias("similarity")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrated(index: Index, k: int, recall: float = 0.95, sample: int = SAMPLE) -> int:
    """The least number of probes with which some of the index's own vectors would find this share of their k nearest."""
    asked = index.filed.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
    asked = graph.written(asked, "annsample")
    near = search.top_k(index.filed, asked, k).join(index.filed.select("id", "cell"), "id").select("query_id", "cell").toPandas()  # sample x k rows
    some = asked.toPandas()
    if not len(near):
        return 1
    order = nearest_cells(search._unit(search._matrix(some["embedding"], index.dim)), index.centres, len(index.centres))
    turn = {q: np.argsort(o, kind="stable") for q, o in zip(some["query_id"], order)}
    needed = np.sort([turn[q][c] for q, c in zip(near["query_id"], near["cell"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of the exact k best that was found."""
    want = exact.where(F.col("rank") <= k).select("query_id", "id")
    got = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return want.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
