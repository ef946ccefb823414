"""Vector code compression: product quantisation in integers, screened by float32 matrix products.

Components become floor(1024 * x). A vector is cut into equal parts, each part position has a codebook of up to 256
entries, and a part's code is the index of the nearest entry (squared Euclidean distance, ties to the lower index).

Nearest entries are found exactly: s = |c|^2 - 2 x.c is computed for a batch of parts and all entries by one float32
matrix product. With u = 2^-24 and parts of k components, every s is within E = 4 (k + 8) u |x||c| + 8 u |c|^2 of the
true value (rounding of the product in any order of summation, of the inputs, of the norms and of the comparison itself
included). Entries whose interval [s - E, s + E] reaches below the least upper end are computed again in int64; the least
of these wins, ties by index. Equal entries are screened once, by their lowest index.

Rounds: every task sums the parts of each entry; a row for each task, part position and entry is shuffled, and
the new codebooks (positions x entries x components, bounded) go through the driver. Components are packed once into a
table of bytes, which the rounds read; the result is computed lazily from the input with the final codebooks, so nothing is left behind.

Edge cases: rows with a null vector, or null or non-finite components, are dropped. The dimension is that of the
least kept vec_id's vector; a vector of another dimension has no parts to compare and is dropped too. If it can't be cut
equally, the first parts are a component longer. Repeated ids are rows of their own, ordered by their components; null ids
come last. Fewer than 256 kept rows make smaller codebooks; an empty table gives an empty result. Components whose sums
or squares could pass 64 bits are computed with Python's integers instead of int64 (same results); an error beyond
2^63 - 1 is given as that. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, scratch, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Parts compared with all entries at a time.
ROWS = 2048
#: Digits in base 2^LIMB carry sums of components that may pass 64 bits.
LIMB = 40
MOST = (1 << 63) - 1
U = 2.0**-24


def integers(vector: np.ndarray, scale: int = SCALE, wide: bool = False) -> np.ndarray:
    """floor(scale * x): int64, or Python's integers."""
    vector = np.asarray(vector, np.float64)
    if not wide:
        return np.floor(vector * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in vector.ravel()]
    out = np.empty(vector.shape, object)
    out.ravel()[:] = exact
    return out


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    ends = [0]
    for k in range(parts):
        ends.append(ends[-1] + dim // parts + (k < dim % parts))
    return list(zip(ends, ends[1:]))


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of x. Both int64, or both Python's integers."""
    n = len(x)
    if x.dtype == object:
        pairs = [min((int(sum((a - b) ** 2 for a, b in zip(row, c))), j) for j, c in enumerate(entries)) for row in x]
        return np.array([j for _, j in pairs], np.int64), np.array([d for d, _ in pairs] + [None], object)[:-1]
    if not entries.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, first = np.unique(entries, axis=0, return_index=True)
    first = np.sort(first)
    c = entries[first]
    index, error = np.empty(n, np.int64), np.empty(n, np.int64)
    cf, k = c.astype(np.float32), c.shape[1]
    c2 = (c.astype(np.float64) ** 2).sum(axis=1)
    for b in range(0, n, ROWS):
        part = x[b : b + ROWS]
        s = c2.astype(np.float32) - 2 * (part.astype(np.float32) @ cf.T)
        norms = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
        wide = ((4 * (k + 8) * U) * norms[:, None] * np.sqrt(c2) + 8 * U * c2).astype(np.float32) * np.float32(1.001)
        reach = (s + wide).min(axis=1)
        rows, cols = np.nonzero(s - wide <= reach[:, None])
        again = exact(part[rows], c[cols])
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(again, starts)
        # rows come in order and their entries ascend: the first that has the least
        hit = np.flatnonzero(again == least[rows])
        hit = hit[np.flatnonzero(np.diff(rows[hit], prepend=-1))]
        index[b : b + ROWS], error[b : b + ROWS] = first[cols[hit]], least
    return index, error


def fitting(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that can be coded."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.select("vec_id", "label", x.alias("embedding")).where(F.col("embedding").isNotNull() & finite)


class Plan:
    """How a table is cut: dimension, parts, and whether 64 bits hold its sums and squares."""

    def __init__(self, dim: int, parts: int, scale: int, largest: float):
        self.dim, self.scale, self.cuts = dim, scale, bounds(dim, parts)
        # 2^40 rows of components below 2^22 sum up below 2^62, squares of parts of up to 2^16 components too
        self.wide = largest * scale >= 2.0**22 or dim > 1 << 16
        self.limbs = int(np.ceil((np.log2(max(largest, 1)) + np.log2(scale) + 2) / LIMB)) if self.wide else 1

    def pack(self, rows: np.ndarray) -> list[bytes]:
        if self.wide:
            return [",".join(map(str, r)).encode() for r in rows]
        return [r.tobytes() for r in rows.astype("<i4")]

    def unpack(self, cells: list[bytes]) -> np.ndarray:
        if not cells:
            return np.empty((0, self.dim), object if self.wide else np.int64)
        if self.wide:
            out = np.empty((len(cells), self.dim), object)
            for k, cell in enumerate(cells):
                out[k] = [int(v) for v in cell.split(b",")] if cell else []
            return out
        return np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), self.dim).astype(np.int64)

    def digits(self, sums: np.ndarray) -> np.ndarray:
        """int64 [limb, component] of a vector of sums; the last limb holds the sign."""
        if not self.wide:
            return sums[None].astype(np.int64)
        low, out = (1 << LIMB) - 1, []
        for k in range(self.limbs):
            out.append([int(v) >> (LIMB * k) if k == self.limbs - 1 else (int(v) >> (LIMB * k)) & low for v in sums])
        return np.array(out, np.int64).reshape(self.limbs, len(sums))

    def whole(self, digits: list[int], size: int) -> list[int]:
        return [sum(int(digits[k * size + i]) << (LIMB * k) for k in range(self.limbs)) for i in range(size)]


def packed(batches, plan: Plan):
    for batch in batches:
        column = batch.column("embedding")
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), plan.dim)
        cells = plan.pack(integers(flat, plan.scale, plan.wide))
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(cells, pa.binary())], names=["vec_id", "label", "q"])


def books_of(rows: np.ndarray, plan: Plan) -> list[np.ndarray]:
    return [rows[:, a:b] for a, b in plan.cuts]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Plan, list[np.ndarray]]:
    """The final codebooks, [entry, component] of each part position."""
    spark = prepare(vectors.sparkSession)
    kept = fitting(vectors)
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).select(F.size("embedding").alias("dim")).first()
    if least is None:
        return Plan(0, parts, scale, 0.0), [np.empty((0, 0), np.int64)] * parts
    kept = kept.where(F.size("embedding") == least.dim)
    largest = kept.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda m, e: F.greatest(m, F.abs(e))))).first()[0] or 0.0
    plan = Plan(least.dim, parts, scale, largest)
    with scratch(spark):
        kinds = f"{kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"
        rows = written(kept.mapInArrow(lambda batches: packed(batches, plan), f"vec_id {kinds}, q binary"), "vectorparts")
        start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
        first = integers(np.array([r.embedding for r in start], np.float64).reshape(len(start), plan.dim), scale, plan.wide)
        books = books_of(first, plan)
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(books)

            def sums(batches, plan=plan, sent=sent):
                books = sent.value
                total = [np.zeros(b.shape, b.dtype) for b in books]
                count = [np.zeros(len(b), np.int64) for b in books]
                for batch in batches:
                    x = plan.unpack(batch.column("q").to_pylist())
                    for p, (a, b) in enumerate(plan.cuts):
                        code, _ = nearest(x[:, a:b], books[p])
                        np.add.at(total[p], code, x[:, a:b])
                        count[p] += np.bincount(code, minlength=len(books[p]))
                for p, c in enumerate(count):
                    used = np.flatnonzero(c)
                    if len(used):
                        yield pd_frame(p, used, c[used], [plan.digits(total[p][e]).ravel().tolist() for e in used])

            got = rows.select("q").mapInArrow(sums, "part int, entry int, count long, sums array<long>")
            width = max(b - a for a, b in plan.cuts) * plan.limbs
            # sums of every task are added by position: at most parts x entries rows
            added = got.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()
            books = [b.copy() for b in books]
            for r in added:
                size = books[r.part].shape[1]
                books[r.part][r.entry] = [v // r["count"] for v in plan.whole(r.sums, size)]
            sent.unpersist()
    return plan, books


def pd_frame(part: int, entry, count, sums) -> pa.RecordBatch:
    n = len(entry)
    return pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(entry, pa.int32()), pa.array(count, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "count", "sums"])


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, plan: Plan, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of the rows that can be coded."""
    kept = fitting(vectors).where(F.size("embedding") == plan.dim)
    if not len(books[0]):
        kept = kept.where(F.lit(False))
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = sent.value
        for batch in packed(batches, plan):
            x = plan.unpack(batch.column("q").to_pylist())
            if not len(x):
                continue
            codes, errors = zip(*(nearest(x[:, a:b], books[p]) for p, (a, b) in enumerate(plan.cuts)))
            text = ["".join(f"{v:02x}" for v in row) for row in np.stack(codes, 1).tolist()]
            error = [min(sum(map(int, row)), MOST) for row in zip(*errors)]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = f"{kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"
    return kept.mapInArrow(run, f"vec_id {kinds}, code string, error long")


def decode(coded: DataFrame, plan: Plan, books: list[np.ndarray]) -> DataFrame:
    """coded with ``decoded``: the entries of each code, as components of the original scale."""

    @F.pandas_udf("array<double>")
    def back(codes: pd.Series) -> pd.Series:
        return codes.map(lambda t: [float(v) / plan.scale for p, b in enumerate(books) for v in b[int(t[2 * p : 2 * p + 2], 16)]])

    return coded.withColumn("decoded", back("code"))


def query(vectors: DataFrame) -> DataFrame:
    plan, books = train(vectors)
    coded = encode(vectors, plan, books)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = encode(vectors, plan, books).groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    nearest_of = """(SELECT r, part, q, min((list_inner_product(q, q) - 2 * list_inner_product(q, e) + list_inner_product(e, e))::BIGINT * 256 + entry) AS best
  FROM parts JOIN book{k} USING (part) GROUP BY ALL)"""
    out = ["""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, part, q[part * len(q) // 4 + 1 : (part + 1) * len(q) // 4] AS q FROM kept, range(4) AS s(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, q AS e FROM parts WHERE r < 256)"""]
    for k in range(rounds):
        out.append(f"""
near{k} AS MATERIALIZED (SELECT part, q, best % 256 AS entry FROM {nearest_of.format(k=k)}),
sums{k} AS (SELECT part, entry, i, sum(q[i]::HUGEINT) AS s, count(*) AS c FROM near{k}, range(1, 1025) AS g(i) WHERE i <= len(q) GROUP BY ALL),
new{k} AS (SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY i) AS e FROM sums{k} GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM book{k} b LEFT JOIN new{k} n USING (part, entry))""")
    out.append(f"""
final AS MATERIALIZED (SELECT r, part, best % 256 AS entry, best // 256 AS d FROM {nearest_of.format(k=rounds)}),
coded AS (SELECT r, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY r),
hashed AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(e) AS v, unnest(range(len(e))) AS i FROM book{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), hashed""")
    return ",".join(out)


SQL = _sql()
