"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight schedule (a piecewise-linear density over training time 0..1). Its
documents form a stream in a fixed pseudo-random order, repeated in epochs until the source's
target is met. The schedule's integral is the cumulative token demand; inverting it at a copy's
place in the stream gives the copy's training position, and the mix is range-sorted by position.

Every document gets as many copies as whole epochs fit the target. What is left of the target is shared by
documents of over ``SMALL`` words and smaller ones in proportion; the former are taken in stream order as
long as half of each fits, and the smaller ones fill what that leaves, so that a source misses its target by
about half of a small document where it has any.

Targets share all words by weight; none is above ``max_epochs`` times its source's size, and what
is cut there is shared again by weight among the rest (water-filling, solved in closed form).

Scale: the only per-group order is inside 4096 hash buckets of each source, so a source with a
third of all rows is spread over 4096 tasks; prefix sums over buckets join the pieces.

Edge cases: null text has size 0; null source is a source of its own, last in order; null or
repeated ids are ordinary rows: a row's bucket and place come from its id and text, so rows of a hot id are dealt
like others, and only rows equal in both (which are interchangeable) share a bucket, as narrow rows that are summed
in order; documents of size 0 are placed but take no words; a very long text is taken whole
or not; other columns are carried by ``mix`` whatever their names; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_text, prepare, text_of, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Words up to which a document may fill what larger ones leave.
SMALL = 200
#: One schedule for each source in turn: knots (time, relative density).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size, ...) -> with place and target; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("place") % len(weights) + 1)
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ((F.sum("source_size").over(everything) - before).cast("double") / after.cast("double"))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("level", F.first(fits, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return ranked.select(*sizes.columns, "place", target.alias("target"))


def invert_demand(share: Column, knots) -> Column:
    """The time at which a schedule has asked for ``share`` (0..1) of all it will ask for."""
    spans = [(t0, g0, t1, g1, (g0 + g1) * (t1 - t0) / 2) for (t0, g0), (t1, g1) in zip(knots, knots[1:])]
    total = sum(s[4] for s in spans)
    out, done = None, 0.0
    for k, (t0, g0, t1, g1, area) in enumerate(spans):
        rest = F.greatest(share * total - done, F.lit(0.0))
        slope = (g1 - g0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(g0 * g0) + rest * (2 * slope), F.lit(0.0)))
        at = F.least(F.lit(t1), F.lit(t0) + 2 * rest / F.greatest(g0 + root, F.lit(1e-12)))
        test = share * total <= done + area
        out = F.when(test, at) if out is None else (out.when(test, at) if k < len(spans) - 1 else out.otherwise(at))
        done += area
    return out.otherwise(F.lit(knots[-1][0])) if len(spans) == 1 else out


def stream_key() -> Column:
    """A row's pseudo-random place in its source's stream; the first three digits are its bucket."""
    return F.md5(F.concat_ws(":", id_text(), F.md5(text_of().cast("binary"))).cast("binary"))


def assign(docs: DataFrame, carry: Column | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken, positions
    (training time of each copy) and, if given, ``carry``."""
    prepare(docs.sparkSession)

    def keyed(*more: Column) -> DataFrame:
        size = word_count(text_of())
        rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), stream_key().alias("key"), *more)
        return rows.withColumn("bucket", F.substring("key", 1, 3)).withColumn("little", F.when(F.col("size") <= SMALL, F.col("size")).otherwise(0))

    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    narrow = written(keyed(), "mix")
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.sum("little").alias("n_little"))
    sources = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size"), F.sum("n_little").alias("little_size")), weights, max_epochs)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = buckets.select("source", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("offset"), (F.sum("n_little").over(upto) - F.col("n_little")).alias("little_offset"))
    whole = F.floor(F.try_divide("target", "source_size")).cast("long")
    offsets = offsets.join(sources, same(offsets, sources)).drop(sources["source"]).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    offsets = written(offsets.withColumn("share", F.try_divide("rest", "source_size") * (F.col("source_size") - F.col("little_size"))), "offsets")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)

    def placed(rows: DataFrame, at: DataFrame) -> DataFrame:
        rows = rows.withColumn("before", F.sum("size").over(within) - F.col("size")).withColumn("little_before", F.sum("little").over(within) - F.col("little"))
        at = at.withColumnRenamed("bucket", "_b").withColumnRenamed("source", "_s")
        joined = rows.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_b", "_s")
        return joined.withColumn("begin", F.col("before") + F.col("offset")).withColumn("little_begin", F.col("little_before") + F.col("little_offset"))

    large = F.col("size") > SMALL
    fits = F.col("begin") - F.col("little_begin") + F.col("size") / 2 < F.col("share")
    big = placed(narrow, offsets).where(large & fits).groupBy("source").agg(F.sum("size").alias("big"))
    at = offsets.join(big, same(offsets, big), "left").drop(big["source"]).withColumn("room", F.col("rest") - F.coalesce("big", F.lit(0)))
    rows = placed(narrow if carry is None else keyed(carry.alias("carried")), at)
    extra = F.when(large, fits).otherwise(F.col("little_begin") + F.col("size") / 2 < F.col("room"))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.col("whole") + F.when(extra, 1).otherwise(0))).otherwise(0).cast("long")
    part = F.when(large, F.try_divide(F.col("begin") - F.col("little_begin"), F.col("share"))).otherwise(F.try_divide("little_begin", "room"))
    kinds = len(schedules)

    def position(e: Column) -> Column:
        done = F.when(e < F.col("whole"), (e * F.col("source_size") + F.col("begin")).cast("double")).otherwise(F.col("whole") * F.col("source_size") + F.col("rest") * F.col("part"))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / F.col("target")))
        out = F.lit(None).cast("double")
        for k in reversed(range(kinds)):
            out = F.when(F.col("place") % kinds == k, invert_demand(share, schedules[k])).otherwise(out)
        return out

    rows = rows.withColumn("copies", copies).withColumn("part", part)
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda e: position(e))).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), *(["carried"] if carry is not None else []))


def training_stream(assigned: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``assign`` -> ``columns``, epoch and position of each copy, range-sorted by position."""
    rows = assigned.select(*columns, F.posexplode("positions").alias("epoch", "position"))
    return rows.repartitionByRange("position", "epoch").sortWithinPartitions("position", "epoch")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training stream: the rows of ``docs``, each as often as it is taken, range-sorted by position."""
    taken = assign(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    return training_stream(taken, "carried").select("carried.*")


def query(docs: DataFrame) -> DataFrame:
    """What the training stream holds of each document: the stream is written in order of position (row numbers in place of
    texts), and words, copies and first position are those found in it."""
    rows = written(assign(docs).drop("copies", "taken").withColumn("row", F.monotonically_increasing_id()), "assigned")
    stream = written(training_stream(rows, "row", "size"), "stream")
    found = stream.groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("position").alias("first_position"))
    none = F.lit(0).cast("long")
    return rows.join(found, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "source", F.coalesce("copies", none).alias("copies"), "first_position")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key, key[1:3] AS bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS place FROM d GROUP BY source),
w AS (SELECT *, (place % 3 + 1) AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, place, least(cap::DOUBLE, coalesce(v.level * w, cap::DOUBLE)) AS target FROM l LEFT JOIN v ON true),
p AS (SELECT d.*, t.source_size, t.target, t.place, floor(t.target / t.source_size)::BIGINT AS whole,
      (sum(size) OVER o - size)::BIGINT AS begin_, (sum(CASE WHEN size <= 200 THEN size ELSE 0 END) OVER o - CASE WHEN size <= 200 THEN size ELSE 0 END)::BIGINT AS little_begin,
      sum(CASE WHEN size <= 200 THEN 0 ELSE size END) OVER (PARTITION BY d.source) AS large_size
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY bucket, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, target - whole * source_size AS rest, (target - whole * source_size) / source_size * large_size AS share FROM p),
f AS (SELECT *, size > 200 AS large, begin_ - little_begin + size / 2 < share AS fits FROM q),
r AS (SELECT *, rest - coalesce(sum(size) FILTER (large AND fits) OVER (PARTITION BY source), 0) AS room FROM f),
x AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, whole + CASE WHEN CASE WHEN large THEN fits ELSE little_begin + size / 2 < room END THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS copies,
      CASE WHEN large THEN (begin_ - little_begin) / share ELSE little_begin / room END AS part FROM r),
c AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN whole > 0 THEN begin_::DOUBLE ELSE rest * part END / target)) AS y FROM x)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies,
  CASE WHEN copies = 0 THEN NULL
       WHEN place % 3 = 0 THEN 2 * y / greatest(1.5 + sqrt(2.25 - 2 * y), 1e-12)
       WHEN place % 3 = 1 THEN y
       WHEN y * 0.875 <= 0.25 THEN 2 * (y * 0.875) / 1.0
       ELSE 0.5 + 2 * greatest(y * 0.875 - 0.25, 0.0) / (0.5 + sqrt(0.25 + greatest(y * 0.875 - 0.25, 0.0) * 6.0)) END AS first_position
FROM c
"""
