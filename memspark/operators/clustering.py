"""Components of similar vectors that are kept up to date from what changes.

``Clustering`` holds a row per vector (key, id, embedding, component, cell). ``advance`` takes the vectors as they are now
and touches only what differs: a component that lost a vector is clustered again by itself, new vectors are compared with
each other and with the cells that their similar ones can be in, and components that a new vector joins become one. The
result is that of clustering everything again.

Scale: old vectors are compared with new ones only, in cells that new ones visit; both sides of a cell are dealt over blocks
of ``TASK_VECTORS``, and a task returns a forest over the components it saw. Components are joined over the graph of new
components and those they touch, not over vectors. Rows of components that did not change are only relabelled, by an
equi-join. At most ``MAX_PIVOTS`` vectors reach the driver; they are kept while the table grows and chosen again once
it has grown by ``REGROW``, so that cells stay small.

Edge cases: null vectors are no members; ids must be unique over all keys, and a vector whose value or key changed counts
as removed and new; equal vectors are similar, those of norm zero only to each other (for a positive threshold); an
empty table gives an empty clustering.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

TASK_VECTORS, MAX_PIVOTS, REGROW = graph.TASK_VECTORS, graph.MAX_PIVOTS, 4


def _units(column) -> np.ndarray:
    m = np.array([np.asarray(x, float) for x in column])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _members(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull()).select(key, "id", F.col("embedding").cast("array<double>").alias("embedding"))


def _blocks(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """rows (key, cell, ...) -> with part and parts of the row's cell."""
    sizes = rows.groupBy(F.col(key).alias("_k"), F.col("cell").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / TASK_VECTORS).alias("parts"))
    out = rows.join(sizes, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_c"))).drop("_k", "_c")
    return out.withColumn("part", F.pmod(F.xxhash64(ident), F.col("parts")))


def bipartite_forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """hits[a, b] -> links (a, b) enough to join what is connected, fewer than there are rows and columns."""
    free_a, free_b, out = np.ones(len(hits), bool), np.ones(hits.shape[1], bool), []
    for root in range(len(hits)):
        if not free_a[root]:
            continue
        free_a[root], front = False, [root]
        while front:
            a = front.pop()
            for b in np.flatnonzero(hits[a] & free_b):
                free_b[b] = False
                out.append((a, int(b)))
                for other in np.flatnonzero(hits[:, b] & free_a):
                    free_a[other] = False
                    out.append((int(other), int(b)))
                    front.append(int(other))
    return out


@dataclass(frozen=True)
class Clustering:
    rows: DataFrame
    pivots: np.ndarray
    threshold: float
    key: str
    #: Vectors when the pivots were chosen.
    base: int

    @classmethod
    def of(cls, vectors: DataFrame, threshold: float, key: str = "workspace") -> Clustering:
        """Cluster everything."""
        members = graph.written(_members(vectors, key), "members")
        labelled = members.join(graph.similar_components(members, threshold, key).select("id", "component"), "id").select(key, "id", "embedding", "component")
        return cls._filed(labelled, threshold, key)

    @classmethod
    def _filed(cls, labelled: DataFrame, threshold: float, key: str) -> Clustering:
        labelled = graph.written(labelled, "labelled")
        n = labelled.count()
        some = labelled.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(max(1, min(MAX_PIVOTS, n // TASK_VECTORS))).toPandas()
        pivots = _units(some["embedding"]) if len(some) else np.zeros((1, 1))
        made = cls(labelled, pivots, threshold, key, n)
        return cls(graph.written(made._home(labelled), "clustering"), pivots, threshold, key, n)

    def _home(self, rows: DataFrame) -> DataFrame:
        """rows (key, id, embedding, component) -> with the cell of the nearest pivot."""
        p = self.pivots
        if len(p) == 1:
            return rows.withColumn("cell", F.lit(0).cast("long"))

        @F.pandas_udf("long")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series((_units(v) @ p.T).argmax(axis=1) if len(v) else [], dtype="int64")

        return rows.withColumn("cell", nearest("embedding"))

    def _visits(self, rows: DataFrame) -> DataFrame:
        """rows -> a row for each cell that can hold a similar vector (home and, within reach of the border, others)."""
        p = self.pivots
        if len(p) == 1:
            return rows.withColumn("cell", F.lit(0).cast("long"))
        reach = float(np.sqrt(max(0.0, 2 - 2 * self.threshold))) + 1e-9
        gaps, threshold = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T)) * reach, self.threshold

        @F.pandas_udf("array<long>")
        def cells(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            m = _units(v)
            dots = m @ p.T
            home = dots.argmax(axis=1)
            near = dots[np.arange(len(m)), home][:, None] - dots <= gaps[home] + 1e-9
            near[~m.any(axis=1)] = threshold <= 0
            near[np.arange(len(m)), home] = True
            return pd.Series([np.flatnonzero(x) for x in near])

        return rows.withColumn("cell", F.explode(cells("embedding")))

    def _links(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """a (component of new), b (component of old) of similar vectors."""
        key, threshold = self.key, self.threshold
        keykind, kind = old.schema[key].dataType.simpleString(), old.schema["id"].dataType.simpleString()
        asked = graph.written(self._visits(new.select(key, "id", "embedding", "component")), "visits")
        places = asked.select(F.col(key).alias("_k"), F.col("cell").alias("_c")).distinct()
        met = old.join(places, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_c")), "left_semi").select(key, "id", "embedding", "component", "cell")
        left = graph.written(_blocks(met, key, "id"), "met")
        right = _blocks(asked, key, "id")
        counts_l = left.select(F.col(key).alias("_k"), F.col("cell").alias("_c"), F.col("parts").alias("other")).distinct()
        counts_r = right.select(F.col(key).alias("_k"), F.col("cell").alias("_c"), F.col("parts").alias("other")).distinct()

        def spread(rows: DataFrame, counts: DataFrame, own: str, far: str) -> DataFrame:
            out = rows.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("cell") == F.col("_c")))
            return out.select(key, "cell", F.col("part").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)).alias(far), "embedding", "component")

        def meet(news: pd.DataFrame, olds: pd.DataFrame) -> pd.DataFrame:
            if not len(news) or not len(olds):
                return pd.DataFrame([], columns=["a", "b"])
            na, nb = np.unique(news["component"].to_numpy(), return_inverse=True), np.unique(olds["component"].to_numpy(), return_inverse=True)
            hits = np.zeros((len(na[0]), len(nb[0])), bool)
            m, o = _units(news["embedding"]), _units(olds["embedding"])
            for at in range(0, len(m), 512):
                x, y = np.nonzero(m[at : at + 512] @ o.T >= threshold)
                hits[na[1][x + at], nb[1][y]] = True
            hits[np.ix_(na[1][~m.any(axis=1)], nb[1][~o.any(axis=1)])] = True  # vectors of norm zero are equal
            links = bipartite_forest(hits)
            return pd.DataFrame([(na[0][a], nb[0][b]) for a, b in links], columns=["a", "b"])

        grid = [key, "cell", "i", "j"]
        news, olds = spread(right, counts_l, "i", "j"), spread(left, counts_r, "j", "i")
        return news.groupBy(*grid).cogroup(olds.groupBy(*grid)).applyInPandas(meet, f"a {kind}, b {kind}")

    def advance(self, vectors: DataFrame) -> Clustering:
        """The clustering of ``vectors`` as they are now, from this one."""
        key = self.key
        now = graph.written(_members(vectors, key), "members")
        was = self.rows.select(F.col("id").alias("_id"), F.col(key).alias("_k"), F.col("embedding").alias("_e"))
        same = (F.col("id") == F.col("_id")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("embedding") == F.col("_e"))
        added = graph.written(now.join(was, same, "left_anti"), "added")
        n_now, n_added = now.count(), added.count()
        if self.base * REGROW + TASK_VECTORS < n_now:
            return self._filed(self._relabelled(now, added).select(key, "id", "embedding", "component"), self.threshold, key)
        if not n_added and n_now == self.rows.count():
            return self
        return Clustering(graph.written(self._relabelled(now, added), "clustering"), self.pivots, self.threshold, key, self.base)

    def _relabelled(self, now: DataFrame, added: DataFrame) -> DataFrame:
        key = self.key
        old = self.rows
        is_now = now.select(F.col("id").alias("_id"), F.col(key).alias("_k"), F.col("embedding").alias("_e"))
        same = (F.col("id") == F.col("_id")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("embedding") == F.col("_e"))
        gone = graph.written(old.join(is_now, same, "left_anti").select("id", "component"), "gone")
        kept = old.join(gone.select("id"), "id", "left_anti")
        # a component that lost a vector is clustered by itself: its vectors are similar to none outside
        torn = gone.select("component").distinct()
        whole = kept.join(torn, "component", "left_anti").select(key, "id", "embedding", "component", "cell")
        rest = graph.written(kept.join(torn, "component", "left_semi").select(key, "id", "embedding", F.col("component").alias("was"), "cell"), "rest")
        again = graph.similar_components(rest, self.threshold, "was").select("id", "component")
        old = graph.written(whole.unionByName(rest.join(again, "id").select(key, "id", "embedding", "component", "cell")), "kept")
        new = added.join(graph.similar_components(added, self.threshold, key).select("id", "component"), "id")
        new = graph.written(self._home(new.select(key, "id", "embedding", "component")), "new")
        joined = graph.components(graph.written(self._links(old, new), "links")).select(F.col("node").alias("_n"), F.col("component").alias("_top"))
        rows = old.unionByName(new)
        return rows.join(joined, rows["component"] == joined["_n"], "left").select(key, "id", "embedding", F.coalesce("_top", "component").alias("component"), "cell")
