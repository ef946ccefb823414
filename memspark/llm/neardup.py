"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles (fewer words: the whole text). Weight = (1 + ln tf)
x idf; idf is ln(1 + (N + 1000) / df) over its value at df = (N + 1000) / 100, at most 1, with df counted
over distinct texts: shingles in up to a hundredth of the texts weigh fully, so that a group of near
copies is not torn by its own frequency, and boilerplate weighs less. The few shingles beyond that are
found exactly by ``sketch.heavy``.

Each of 64 samples takes, by Ioffe's scheme, the element with the least a = c / (y e^r), where
ln y = r (t - beta), t = floor(ln w / r + beta); r, c ~ Gamma(2, 1) and beta ~ U(0, 1) are read from a
table of 65,536 draws at a hash of element and sample. Two texts agree in a sample with a probability
of their weighted Jaccard similarity. Sixteen bands of four samples give buckets; pairs are verified by
exact weighted Jaccard similarity of 0.8 or more.

A bucket never yields all its pairs. Exact copies are collapsed first, so hot copies weigh nothing. Every
member is verified against the bucket's least member; where that leaves a bucket in several classes, its
members are compared with each other in blocks of 512 texts or 4 MB of them, first by their samples, then exactly, until it is
settled: no class that a link of the bucket would join stays apart. A bucket of n texts that are alike
enough to share it and yet in several classes costs n^2 / 2 comparisons of 64 samples, spread over
p^2 / 2 tasks for its p blocks, and each text travels p times.

Edge cases: equal texts are always one class, texts without words too (null is the empty text); null
ids get the class but never name it unless all are null; repeated rows are copies; ties take the least
id; a very long text costs memory in proportion to its words; other columns are carried by ``one_of_each``
whatever their names, and not read otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch, takes_over, text_of, written
from .sketch import heavy

WORDS_A_SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Share of the texts up to which a shingle weighs fully, and texts without it that are added to the count.
COMMON, UNSEEN = 0.01, 1000
#: Texts of a bucket in a block, and bytes of text; samples of the 64 that two texts must share to be compared exactly (at a
#: similarity of 0.8 fewer agree in four pairs of a million).
BLOCK, BLOCK_BYTES, SCREEN = 512, 4 << 20, 36
_K = BANDS * ROWS
_MEMO = 300_000

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1 << 30, 1 << 31, _K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_R, _LOG_C, _BETA = _rng.gamma(2.0, 1.0, 1 << 16), np.log(_rng.gamma(2.0, 1.0, 1 << 16)), _rng.random(1 << 16)
#: ln a at weight 1, where t = 0. Draws are kept in its order, so that at weight 1 the least hash wins.
_UNIT = _LOG_C + _R * _BETA - _R
_ORDER = np.argsort(_UNIT)
_R, _LOG_C, _BETA, _UNIT = _R[_ORDER], _LOG_C[_ORDER], _BETA[_ORDER], _UNIT[_ORDER]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def begin() -> None:
    takes_over("neardup", _words.clear)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(WORDS_A_SHINGLE, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += (t[j : n - k + 1 + j] ^ (t[j : n - k + 1 + j] >> np.uint64(32))) * _ODD[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h, return_counts=True)


class Idf:
    """Weights: 1 but for the common shingles."""

    def __init__(self, df: dict[int, int], n: int):
        self.keys = np.array(sorted(df), np.uint64)
        counts = np.array([df[int(k)] for k in self.keys.tolist()], float)
        self.values = np.minimum(1.0, np.log1p((n + UNSEEN) / np.maximum(counts, 1)) / np.log1p(1 / COMMON))

    def weights(self, keys: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1.0 + np.log(tf)
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            w[hit] *= self.values[at[hit]]
        return w


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of a weighted set, each as a hash of element and level."""
    x = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
    plain, other = np.flatnonzero(weights == 1.0), np.flatnonzero(weights != 1.0)
    best, chosen, level = np.full(_K, np.inf), np.zeros(_K, np.uint64), np.zeros(_K, np.int64)
    column = np.arange(_K)
    with np.errstate(over="ignore"):
        for at in range(0, len(plain), 1 << 14):
            some = plain[at : at + (1 << 14)]
            place = _MULT[:, None] * x[some][None, :]
            k = np.argmin(place, axis=1)
            a = _UNIT[place[column, k] >> np.uint32(16)]
            chosen = np.where(a < best, keys[some[k]], chosen)
            best = np.minimum(a, best)
        for at in range(0, len(other), 1 << 12):
            some = other[at : at + (1 << 12)]
            place = (_MULT[:, None] * x[some][None, :]) >> np.uint32(16)
            r, beta = _R[place], _BETA[place]
            t = np.floor(np.log(weights[some])[None, :] / r + beta)
            a = _LOG_C[place] - r * (t - beta) - r
            k = np.argmin(a, axis=1)
            less = a[column, k] < best
            chosen = np.where(less, keys[some[k]], chosen)
            level = np.where(less, t[column, k].astype(np.int64), level)
            best = np.minimum(a[column, k], best)
        return (chosen ^ (chosen >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def banded(drawn: np.ndarray) -> np.ndarray:
    """The band hashes of some samples."""
    rows = drawn.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        for j in range(ROWS):
            h = (h ^ rows[:, j]) * np.uint64(0xA0761D6478BD642F)
            h ^= h >> np.uint64(32)
    return h


def signature(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The band hashes of a weighted set."""
    return banded(samples(keys, weights))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the least node of each component, by propagation and pointer jumps."""
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        new = written(new, "labels")
        up = new.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = written(new.join(up, new["label"] == up["up"]).select("node", "old", F.least("label", "top").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


class NearDuplicates:
    """The distinct texts of ``docs`` with their classes; see the module's text."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        spark = prepare(docs.sparkSession)
        self.threshold = threshold
        rows = docs.select(F.col("doc_id"), text_of().alias("text"))
        keyed = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), "text")
        self.members = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"))
        self.texts = written(keyed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts", compression="zstd")

        def keys_of(texts):
            begin()
            keys = np.concatenate([shingles(t)[0] for t in texts]) if texts else np.zeros(0, np.uint64)
            yield keys, np.ones(len(keys), np.int64), np.zeros(len(keys), np.uint64)

        df, n, _ = heavy(self.texts.select("text"), keys_of, lambda n, total: max(2, int(np.ceil(COMMON * (n + UNSEEN)))))
        self.idf = spark.sparkContext.broadcast(Idf({k: c for k, (c, _) in df.items()}, n))
        idf = self.idf

        def sketch(batches):
            begin()
            for pdf in batches:
                rows = []
                for node, text in zip(pdf["node"], pdf["text"]):
                    k, tf = shingles(text)
                    if len(k):
                        drawn = samples(k, idf.value.weights(k, tf))
                        rows.append((node, banded(drawn).astype(np.int64), drawn.astype("<u4").tobytes(), len(text)))
                if rows:
                    yield pd.DataFrame(rows, columns=["node", "bands", "samples", "size"])

        sketches = written(self.texts.select("node", "text").mapInPandas(sketch, "node string, bands array<long>, samples binary, size long"), "sketches", compression="zstd")
        bucketed = sketches.select("node", "size", F.explode("bands").alias("bucket"))
        leaders = bucketed.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = written(bucketed.join(leaders, "bucket"), "buckets")
        stars = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        links = written(self.verified(stars), "links")
        labels = components(links)
        more = written(self.settled(shared, labels, sketches), "links")
        self.links = links.unionAll(more)
        self.labels = labels if more.isEmpty() else components(self.links)

    def settled(self, shared: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
        """Links (a, b, similarity) that join texts which share a bucket but not yet a class. The texts of such a
        bucket (its leader is done) are dealt over blocks; every two blocks meet in one task, where pairs that share enough samples
        and are still apart in the task are compared exactly, each in the first bucket that holds both. A task
        returns a forest: a link is only left out where others of the task already join its ends."""
        idf, least = self.idf, self.threshold
        # every member has been compared with its leader
        apart = shared.where("n > 2 and node <> leader").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = apart.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts")).where("x <> y").select("bucket", "parts")
        apart = apart.select("bucket", "node", "label").join(mixed, "bucket")
        apart = apart.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
        dealt = apart.select("bucket", "node", "label", "p", F.explode(meet).alias("c")).select("bucket", "node", "label", "p", "c.i", "c.j")
        dealt = dealt.join(sketches.drop("size"), "node").join(self.texts.select("node", "text"), "node")

        def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            begin()
            bucket, i, j = key
            n = len(pdf)
            nodes, texts, part = pdf["node"].tolist(), pdf["text"].tolist(), pdf["p"].to_numpy()
            drawn = np.frombuffer(b"".join(pdf["samples"]), "<u4").reshape(n, _K)
            bands = np.stack(pdf["bands"].tolist())
            tree = {x: k for k, x in enumerate(dict.fromkeys(pdf["label"]))}
            start = np.array([tree[x] for x in pdf["label"]])
            parent = list(range(len(tree)))
            weighed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def of(x):
                if x not in weighed:
                    k, tf = shingles(texts[x])
                    weighed[x] = k, idf.value.weights(k, tf)
                return weighed[x]

            out = []
            for x in range(n):
                maybe = np.flatnonzero((start[x + 1 :] != start[x]) & ((i == j) | (part[x + 1 :] != part[x]))) + x + 1
                maybe = maybe[(drawn[maybe] == drawn[x]).sum(axis=1) >= SCREEN]
                if not len(maybe):
                    continue
                same = bands[maybe] == bands[x]
                for y in maybe[bands[x][np.argmax(same, axis=1)] == bucket].tolist():
                    u, v = root(start[x]), root(start[y])
                    if u != v and (s := similarity(of(x), of(y))) >= least:
                        parent[v] = u
                        out.append((*sorted((nodes[x], nodes[y])), s))
            return pd.DataFrame(out, columns=["a", "b", "similarity"])

        return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "a string, b string, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar enough, with their similarity."""
        idf, least = self.idf, self.threshold
        a = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

        def check(batches):
            begin()
            held = ("", None)
            for pdf in batches:
                out = []
                for x, y, s, t in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                    if held[0] != x:
                        k, tf = shingles(s)
                        held = (x, (k, idf.value.weights(k, tf)))
                    k, tf = shingles(t)
                    j = similarity(held[1], (k, idf.value.weights(k, tf)))
                    if j >= least:
                        out.append((x, y, j))
                if out:
                    yield pd.DataFrame(out, columns=["a", "b", "similarity"])

        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(check, "a string, b string, similarity double")

    def classes(self) -> DataFrame:
        """node, class_id (least document id of the class), links of each distinct text."""
        ends = self.links.select(F.col("a").alias("node")).unionAll(self.links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        labelled = self.texts.select("node", "rep", "copies").join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = labelled.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
        return labelled.join(named, "label").join(ends, "node", "left").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "label")


def query(docs: DataFrame) -> DataFrame:
    with scratch(docs.sparkSession):
        found = NearDuplicates(docs)
        classes = written(found.classes(), "classes", keep=True)
    return found.members.join(classes, "node").select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of least id of each class, with all its columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    with scratch(docs.sparkSession):
        found = NearDuplicates(docs)
        members = found.members.join(found.classes().select("node", "label"), "node")
        first = members.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("least"), "doc_id", "node")).alias("w"))
        first = written(first.select(id_text("w.doc_id").alias("__id"), F.col("w.node").alias("__node")), "first", keep=True)
    keyed = docs.select(F.struct(*columns).alias("__row"), id_text().alias("__id"), F.md5(text_of().cast("binary")).alias("__node"))
    kept = keyed.join(first, ["__id", "__node"], "left_semi").groupBy("__id", "__node").agg(F.first("__row").alias("__row"))
    return kept.select("__row.*")
