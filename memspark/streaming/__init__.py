"""Structured Streaming forms of the incremental paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dml, graph
from ..schema import MemoryState


def deduplicated(stream: DataFrame, window_s: int, keys=("workspace", "content"), time: str = "ts") -> DataFrame:
    """Drop what repeats within the watermark."""
    return stream.withWatermark(time, f"{window_s} seconds").dropDuplicatesWithinWatermark(list(keys))


def deduplicated_exact(stream: DataFrame, window_s: float, time: str = "created_at") -> DataFrame:
    """(workspace, content, id, created_at): pass a row unless its content passed within the window before;
    a dropped row does not lengthen the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, "id"])
        out = []
        for r in rows.itertuples(index=False):
            t = float(getattr(r, time))
            if last is None or t - last > window_s:
                out.append((key[0], key[1], r.id, t))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["workspace", "content", "id", time])

    shape = f"workspace string, content string, id string, {time} double"
    return stream.groupBy("workspace", "content").applyInPandasWithState(step, shape, "last double", "append", GroupStateTimeout.NoTimeout)


def ring(stream: DataFrame, capacity: int = 64) -> DataFrame:
    """(workspace, seq, content): after each batch the last ``capacity`` notes of each workspace that got any."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, contents = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("seq")
        seqs = [*seqs, *rows["seq"].tolist()][-capacity:]
        contents = [*contents, *rows["content"].tolist()][-capacity:]
        state.update((seqs, contents))
        yield pd.DataFrame({"workspace": key[0], "seq": seqs, "content": contents})

    return stream.groupBy("workspace").applyInPandasWithState(step, "workspace string, seq long, content string", "seqs array<bigint>, contents array<string>", "update", GroupStateTimeout.NoTimeout)


def after_mark(stream: DataFrame, mark: float) -> tuple[DataFrame, DataFrame]:
    """(rows after the high-water mark, rows at or before it, which are late and kept apart)."""
    return stream.where(F.col("created_at") > mark), stream.where(F.col("created_at") <= mark)


class MarkCounts:
    """Counts of a stream's rows on both sides of a high-water mark, from the metrics that ``Dataset.observe`` reports
    with each finished batch; the stream itself is read once."""

    def __init__(self, mark: float, name: str = "mark"):
        self.mark, self.name = mark, name

    def watch(self, stream: DataFrame) -> DataFrame:
        late = F.col("created_at").isNull() | (F.col("created_at") <= self.mark)
        return stream.observe(self.name, F.count_if(~late).alias("passed"), F.count_if(late).alias("late"), F.max("created_at").alias("highest"))

    def passed(self, stream: DataFrame) -> DataFrame:
        """The rows after the mark; those without a time are late."""
        return self.watch(stream).where(F.col("created_at") > self.mark)

    def of(self, query: StreamingQuery) -> dict[str, float]:
        """Sums over the batches that the query reports (its last ``spark.sql.streaming.numRecentProgressUpdates``)."""
        seen = {p["batchId"]: p["observedMetrics"][self.name] for p in query.recentProgress if self.name in (p["observedMetrics"] or {})}
        highs = [r["highest"] for r in seen.values() if r["highest"] is not None]
        return {"passed": sum(r["passed"] for r in seen.values()), "late": sum(r["late"] for r in seen.values()), "highest": max([self.mark, *highs])}


#: Groups over which ids that will expire are dealt.
EXPIRY_BUCKETS = 4096


def expiring(stream: DataFrame, delay: str = "0 seconds", buckets: int = EXPIRY_BUCKETS) -> DataFrame:
    """(id, created_at timestamp, expires_at timestamp) -> (id, expires_at): each id once, when the watermark has
    passed its time; a later row of an id replaces its time. State is held for live ids only: a timer in event time drops it. Ids whose
    time never comes, and rows later than the watermark allows, give nothing.

    Ids are dealt over ``buckets`` by hash. A bucket's live ids are one row of state with one timer, at the earliest of their
    times, so a batch costs a call for each bucket it touches and not for each id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.Series(list(state.get[1]), list(state.get[0]), "int64") if state.exists else pd.Series([], [], "int64")
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["created_at", "ms"]).drop_duplicates("id", keep="last")
            held = pd.concat([held[~held.index.isin(rows["id"])], pd.Series(rows["ms"].to_numpy(), rows["id"].to_numpy(), "int64")])
        gone = held < state.getCurrentWatermarkMs()
        live = held[~gone]
        if len(live):
            state.update((live.index.tolist(), live.tolist()))
            state.setTimeoutTimestamp(max(1, int(live.min())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": held.index[gone], "ms": held[gone].to_numpy()})

    timed = stream.where("id is not null and expires_at is not null").select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "created_at", F.unix_millis("expires_at").alias("ms")).withWatermark("created_at", delay)
    gone = timed.groupBy("bucket").applyInPandasWithState(step, "id string, ms long", "ids array<string>, ms array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return gone.select("id", F.timestamp_millis("ms").alias("expires_at"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Event-time windows with a watermark (an extension)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def expire(state: MemoryState, now: float) -> MemoryState:
    """Retire intents past their time: the body of a batch."""
    from ..operators.cycle import expired

    gone = graph.written(expired(state.memories, now).select(F.col("id").alias("old_id"), F.lit(None).cast("string").alias("new_id")), "expired")
    return graph.retire(state, gone, now)


def append_events(state: MemoryState, batch: DataFrame) -> MemoryState:
    return dml.put_memories(state, batch, "created_at")


class Worker:
    """Runs a step over the rows that arrive: on a timer, or once over what is there. No row is lost.

    Every micro-batch is first written under its number to ``pending`` (a batch that Spark runs again replaces
    itself). With every ``every``-th batch, and with each batch after a failure, the step gets all that is pending, in one
    frame with the column ``batch_id``, and the number of the last batch; what it got is removed only after it has returned. A step that fails leaves its
    rows pending. After ``max_errors`` failures in a row the error reaches Spark and the stream ends (None: never); its last
    batch then is not committed, and the next start from the same checkpoint takes up the pending rows.

    ``once`` raises the first error, and at its end runs the step over what ``every`` has left. A step may see rows again if the driver
    is lost between the step's end and the removal: steps write under the batch numbers they get, or replace what they wrote.
    A stream of empty batches leaves nothing pending and does not call the step."""

    def __init__(self, step: Callable[[DataFrame, int], None], interval_s: int = 300, max_errors: int | None = 10, every: int = 1):
        self.step, self.interval_s, self.max_errors, self.every = step, interval_s, max_errors, max(1, every)
        self.errors, self.since = 0, 0

    @staticmethod
    def _folders(spark: SparkSession, pending: str) -> tuple[object, list]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(pending)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        # a folder without its marker is a batch whose write did not end
        return fs, [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def drain(self, spark: SparkSession, pending: str) -> None:
        """The step over all pending batches."""
        fs, folders = self._folders(spark, pending)
        if not folders:
            return
        last = max(int(p.getName().split("=")[1]) for p in folders)
        self.step(spark.read.option("basePath", pending).parquet(*[p.toString() for p in folders]), last)
        for p in folders:
            fs.delete(p, True)

    def _batch(self, pending: str, strict: bool) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            if not batch.isEmpty():
                batch.write.mode("overwrite").parquet(f"{pending}/batch_id={batch_id}")
            self.since += 1
            if self.since < self.every and not self.errors:
                return
            try:
                self.drain(batch.sparkSession, pending)
                self.errors, self.since = 0, 0
            except Exception:
                self.errors += 1
                if strict or (self.max_errors is not None and self.errors >= self.max_errors):
                    raise

        return run

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        pending = f"{checkpoint.rstrip('/')}-pending"
        return stream.writeStream.foreachBatch(self._batch(pending, False)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{self.interval_s} seconds").start()

    def once(self, stream: DataFrame, checkpoint: str) -> None:
        pending = f"{checkpoint.rstrip('/')}-pending"
        stream.writeStream.foreachBatch(self._batch(pending, True)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        self.drain(stream.sparkSession, pending)
        self.errors = self.since = 0
