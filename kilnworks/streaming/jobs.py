"""Streaming jobs: event ingestion, micro-batch debounce, outcome sweep, scoring, snapshot sink.

Every job drains what is there (``availableNow``) and can be restarted from its
checkpoint. Sinks are safe to repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from kilnworks import schemas as X
from kilnworks.operators.delay import outcome_labels
from kilnworks.operators.scale import last_per_key
from kilnworks.session import durable

LOOKBACK = "24 hours"


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _ended(q, seconds: float | None) -> None:
    """Wait for the end of a draining stream, for ever unless a limit is given."""
    if seconds is None:
        q.awaitTermination()
    elif not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError("the stream did not drain in time")


def drain(df: DataFrame, path: str, checkpoint: str, partition: str | None = None, timers: bool = False,
          seconds: float | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet sink, then read the sink.

    A stream with processing-time timers asks for another empty batch for ever, so
    draining one leaves those batches out; a continuous run keeps them.
    """
    spark = df.sparkSession
    before = spark.conf.get(NO_DATA)
    if timers:
        spark.conf.set(NO_DATA, "false")
    try:
        w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet")
        q = (w.partitionBy(partition) if partition else w).start(path)
        _ended(q, seconds)
    finally:
        spark.conf.set(NO_DATA, before)
    return spark.read.schema(df.schema).parquet(path)


def for_each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> None:
    """Drain a stream through a batch writer; a batch counts only once the writer has returned."""
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    _ended(q, seconds)


# --- events -----------------------------------------------------------------
def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event envelopes as they arrive; the label travels in the event itself."""
    return spark.readStream.schema(X.EVENT).json(path)


def topic(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("topic") == name)


def batch_ready(n: Column, oldest: Column, now: Column, min_count: int, max_age_seconds: float) -> Column:
    """Enough events, or the oldest has waited long enough; never for an empty batch."""
    return (n > 0) & ((n >= min_count) | (now - oldest >= max_age_seconds))


READY = "tenant string, topic string, batches bigint, events bigint, oldest double, reason string"


def partial_counts(events: DataFrame) -> DataFrame:
    """tenant, topic, n, oldest: one row for each key and task of a micro-batch, so a busy key is counted where its events are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]).group_by(["tenant", "topic"]).aggregate([("ts", "count"), ("ts", "min")]) for b in batches if b.num_rows]
        if parts:
            whole = pa.concat_tables(parts).group_by(["tenant", "topic"]).aggregate([("ts_count", "sum"), ("ts_min", "min")])
            yield from whole.select(["tenant", "topic", "ts_count_sum", "ts_min_min"]).rename_columns(["tenant", "topic", "n", "oldest"]).to_batches()

    return events.select("tenant", "topic", F.coalesce(F.col("ts"), F.lit(0.0)).alias("ts")).mapInArrow(count, "tenant string, topic string, n long, oldest double")


class Debounce(StatefulProcessor):
    """State of a key: how many events wait and when the oldest of them was; a timer for when it has waited too long."""

    def __init__(self, min_count: int, max_age_ms: int):
        self.min_count, self.max_age_ms = min_count, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n bigint, oldest double")

    def _row(self, key: tuple, batches: int, events: int, oldest: float, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"tenant": [key[0]], "topic": [key[1]], "batches": [batches], "events": [events], "oldest": [oldest], "reason": [reason]})

    def _forget(self) -> None:
        self.pending.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waiting, oldest = self.pending.get() if self.pending.exists() else (0, float("inf"))
        came, first = 0, float("inf")
        for part in rows:
            came, first = came + int(part["n"].sum()), min(first, float(part["oldest"].min()))
        n, oldest = waiting + came, min(oldest, first)
        full, left = divmod(n, self.min_count)
        self._forget()
        if full:
            yield self._row(key, full, full * self.min_count, oldest, "count")
            oldest = first  # what is left came now; its oldest event is not older than that
        if left:
            due = int(oldest * 1000) + self.max_age_ms
            if due <= timerValues.getCurrentProcessingTimeInMs():
                yield self._row(key, 1, left, oldest, "age")
            else:
                self.pending.update((left, oldest))
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            n, oldest = self.pending.get()
            self.pending.clear()
            yield self._row(key, 1, n, oldest, "age")

    def close(self) -> None:
        pass


def debounce(events: DataFrame, min_count: int, max_age_ms: int) -> DataFrame:
    """Stream of ready micro-batches per (tenant, topic): full ones of ``min_count`` events by arithmetic, the rest once its oldest event is too old.

    State and timers are kept by :class:`Debounce`; the events of a micro-batch are counted before they meet, so a key
    with a third of all events is a few rows. Run it with :func:`drain_debounced`; what still waits at the end comes from :func:`waiting`.
    """
    return partial_counts(events).groupBy("tenant", "topic").transformWithStateInPandas(
        statefulProcessor=Debounce(min_count, max_age_ms), outputStructType=READY, outputMode="Append", timeMode="ProcessingTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain_debounced(ready: DataFrame, path: str, checkpoint: str, seconds: float | None = None) -> DataFrame:
    """Drain a debounced stream; its state needs the store that keeps timers."""
    spark = ready.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return drain(ready, path, checkpoint, timers=True, seconds=seconds)
    finally:
        spark.conf.set(PROVIDER, before)


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The closing step: what a stopped debounced stream still holds, one batch for each key, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    return state.select("key.tenant", "key.topic", F.lit(1).cast("long").alias("batches"), F.col("value.n").alias("events"), F.col("value.oldest").alias("oldest"),
                        F.lit("close").alias("reason"))


# --- outcomes ---------------------------------------------------------------
def drop_late_copies(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Re-read overlap is harmless: a key seen again within the look-back is dropped."""
    return stream.withWatermark(at, LOOKBACK).dropDuplicatesWithinWatermark([key])


def write_outcomes(path: str, work_orders: DataFrame) -> Callable[[DataFrame, int], None]:
    """Batch writer of outcome records: one folder per batch, replaced if the batch is repeated.

    Readers take the newest record per order, so sweeping an order twice changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        done = outcome_labels(batch.filter("status <> 'CANCELLED'"), work_orders)
        done.withColumn("swept", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return last_per_key(spark.read.parquet(path).drop("batch"), ["job_id"], ["swept"])


def sweep_outcomes(completed: DataFrame, work_orders: DataFrame, root: str, lookback: str = LOOKBACK) -> dict[str, int]:
    """Outcomes of orders completed since the bookmark less the look-back; the bookmark moves after the write.

    A failed write leaves the bookmark, so the next sweep repeats the whole window.
    """
    spark = completed.sparkSession
    marks = f"{root}/bookmark"
    # a bookmark table that is not there yet means the first sweep
    try:
        mark = spark.read.schema("sweep int, completed_at timestamp").parquet(marks).agg(F.max("completed_at").alias("m"), F.max("sweep").alias("s")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        mark = None
    sweep = 0 if mark is None else mark["s"] + 1
    found = completed
    if mark is not None and mark["m"] is not None:
        found = completed.filter(F.col("completed_at") > F.lit(mark["m"]) - F.expr(f"INTERVAL {lookback}"))
    # what is written and what the bookmark is taken from are the same rows, also if the source grows meanwhile
    found = durable(found)
    write_outcomes(f"{root}/outcomes", work_orders)(found, sweep)
    seen = found.filter("status <> 'CANCELLED'").agg(F.max("completed_at").alias("completed_at"), F.count(F.lit(1)).alias("n")).first()
    newest = seen["completed_at"] if seen["completed_at"] is not None else (mark["m"] if mark else None)
    if newest is not None:
        spark.createDataFrame([(sweep, newest)], "sweep int, completed_at timestamp").coalesce(1).write.mode("append").parquet(marks)
    return {"sweep": sweep, "written": seen["n"]}


# --- scoring and snapshots --------------------------------------------------
def score_stream(drafts: DataFrame, rates: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Draft lines joined to the static rate table of their customer and scored as they arrive."""
    own = rates.withColumnsRenamed({"entity": "__e", "rate": "contact_win_rate"})
    return score(drafts.join(own, F.col(key).cast("string") == F.col("__e"), "left").drop("__e"))


def snapshot_sink(scored: DataFrame, path: str, checkpoint: str, at: str) -> DataFrame:
    """Append one immutable record per scoring event, in folders by UTC date."""
    return drain(scored.withColumn("dt", F.date_format(at, "yyyy-MM-dd")), path, checkpoint, partition="dt")
