"""Structured Streaming monitors for append-only prediction and access logs."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.scalars import argmax, entropy, f64, is_finite
from ..operators.health import HIGH, LOW


def monitor_runs(
    stream: DataFrame, keys: Sequence[str], ts: str = "ts", probs: Sequence[str] = ("p0", "p1"),
    delay: str = "1 hour", window: str = "1 hour",
) -> DataFrame:
    """Predicted histogram, entropy, collapse and NaN flags per key and event-time window.

    The expressions are those of the batch operators; run with output mode 'update' or 'append'. Rows
    behind the watermark have no window any more; `LateRowLog` counts those that a query left out.
    """
    pred = argmax(probs)
    bad = ~is_finite(probs[0])
    for p in probs[1:]:
        bad = bad | ~is_finite(p)
    agg = stream.withWatermark(ts, delay).groupBy(F.window(ts, window), *keys).agg(
        F.count_if(pred == 0).alias("n0"), F.count_if(pred == 1).alias("n1"),
        F.avg(entropy(probs, "clip")).alias("mean_entropy"), F.bool_or(bad).alias("has_nan"),
    )
    share = f64("n0") / (F.col("n0") + F.col("n1"))
    return agg.withColumn("collapsed", (share <= LOW) | (share >= HIGH)).select(
        F.col("window.start").alias("window_start"), *keys, "n0", "n1", "mean_entropy", "has_nan", "collapsed"
    )


def late_rows(job: StreamingQuery) -> int:
    """Rows behind the watermark that a query has left out, over the batches whose progress the session keeps.

    The session keeps `spark.sql.streaming.numRecentProgressUpdates` of them; `LateRowLog` serves queries that
    run for longer or are restarted.
    """
    return sum(int(s["numRowsDroppedByWatermark"]) for p in job.recentProgress for s in p["stateOperators"])


class LateRowLog(StreamingQueryListener):
    """Writes the rows that every batch left out behind the watermark to a table that outlives queries and sessions.

    Spark drops late rows where they reach the state, after each task has combined its rows of one group and
    window, so late rows of one task, group and window count once.

    Register with `spark.streams.addListener`. A query keeps its id when it restarts from its checkpoint, and a batch
    that is done over after a failure reports once more, so `total` takes one count for each query and batch. Batches that lost
    nothing are not written. Events come a little after their batch: `settled` waits until a run's end was seen.
    """

    SCHEMA = "query_id string, batch_id bigint, late_rows bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run_id) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        late = sum(int(s.numRowsDroppedByWatermark) for s in event.progress.stateOperators)
        if late:
            row = (str(event.progress.id), int(event.progress.batchId), late)
            self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def settled(self, job: StreamingQuery, timeout: float = 60.0) -> bool:
        """True once all events of an ended run were taken in."""
        return self._end(job.runId).wait(timeout)

    @classmethod
    def total(cls, spark: SparkSession, path: str) -> DataFrame:
        """`late_rows` per query_id; a query that lost none has no row."""
        batches = spark.read.schema(cls.SCHEMA).parquet(path).groupBy("query_id", "batch_id").agg(F.max("late_rows").alias("late_rows"))
        return batches.groupBy("query_id").agg(F.sum("late_rows").alias("late_rows"))


_FLIP = Row("run_id", "sample_id", "epoch", "before", "after", "flipped", "late_rows")


class _LastPrediction(StatefulProcessor):
    """Keeps (epoch, prediction) per sample of a run; emits flips, counts late epochs, forgets idle samples.

    A sample has few rows in a batch, so they come as rows: a pandas frame for each sample would cost more than all else.
    """

    def __init__(self, ttl_ms: int | None, idle_ms: int | None = None):
        self._ttl, self._idle = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "epoch bigint, pred bigint, late bigint", self._ttl)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held = self._last.get()
        if held is None or initialState["epoch"] >= held[0]:
            self._last.update((int(initialState["epoch"]), int(initialState["pred"]), 0))
        self._touch(timerValues)

    def _touch(self, timerValues) -> None:
        """The only timer of a key is the one set by its newest rows."""
        if self._idle:
            for at in list(self._handle.listTimers()):
                self._handle.deleteTimer(at)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        epoch, pred, late = self._last.get() or (None, None, 0)
        out = []
        for e, q in sorted(((r["epoch"], r["pred"]) for r in rows), key=itemgetter(0)):
            if epoch is not None and e <= epoch:
                late += 1
                continue
            if pred is not None:
                out.append(_FLIP(*key, int(e), pred, int(q), q != pred, late))
            epoch, pred = int(e), int(q)
        self._last.update((epoch, pred, late))
        self._touch(timerValues)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


CHURN_SCHEMA = "run_id bigint, sample_id bigint, epoch bigint, before bigint, after bigint, flipped boolean, late_rows bigint"


def monitor_churn(stream: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """One row per prediction that follows an earlier one of the same (run_id, sample_id).

    Expects run_id, sample_id, epoch, pred. State is one small value per sample, partitioned by
    (run, sample), so a hot run spreads over all tasks. An epoch at or before the last seen one is
    ignored and counted. `initial`, a batch table of the same columns, says what was predicted before the stream
    began: its newest epoch of a sample is where that sample goes on. A sample without rows for `idle_ms` belongs to a
    finished run; a timer forgets it. With `idle_ms` or `ttl_ms` Spark plans batches for as long as the query runs, so
    start it with a processing-time trigger, not with `run_available`. Needs the RocksDB state store, see `state_session`.
    """
    names = ["run_id", "sample_id", "epoch", "pred"]
    mode = "ProcessingTime" if ttl_ms or idle_ms else "None"
    return stream.select(*names).groupBy("run_id", "sample_id").transformWithState(
        statefulProcessor=_LastPrediction(ttl_ms, idle_ms), outputStructType=CHURN_SCHEMA, outputMode="append", timeMode=mode,
        initialState=None if initial is None else initial.select(*names).groupBy("run_id", "sample_id"),
    )


def held_predictions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a churn monitor holds, read from its checkpoint by the state data source: newest epoch and prediction of every sample."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return state.select("key.run_id", "key.sample_id", "value.epoch", "value.pred", F.col("value.late").alias("late_rows"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same context whose streams keep state in RocksDB; settings of `spark` itself stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def monitor_label_access(stream: DataFrame, training_ends: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Alerts for label reads at or before the end of training, or of a run without a recorded end.

    A stream-static join; Spark chooses a broadcast only when the static side is small enough.
    """
    reads = stream.where(F.col("kind") == "label_read")
    joined = reads.join(training_ends.select(key, "training_end"), key, "left")
    late = F.col("training_end").isNull() | (F.col(ts) <= F.col("training_end"))
    return joined.where(late).select(key, ts, "training_end")


def run_available(stream: DataFrame, name_or_path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Process everything that is available and stop, with the checkpoint in shared storage."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format(fmt).start(name_or_path) if fmt != "memory" else writer.format("memory").queryName(name_or_path).start()
    query.awaitTermination()
