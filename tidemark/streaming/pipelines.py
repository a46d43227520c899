"""Streams: ingest, counts, sessions, deduplication, retries, throttling, the job queue and scheduled runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Jobs
from tidemark.operators.jobs import after_pass, due
from tidemark.sources.ingest import memory_rows
from tidemark.sources.store import insert_or_ignore


def ingest(events: DataFrame) -> DataFrame:
    """Stateless: accepted events as memory rows."""
    return memory_rows(events)


def event_time(rows: DataFrame, column: str, late: str) -> DataFrame:
    """With a watermark; zone-less times are read as UTC (the session's zone)."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def counts(rows: DataFrame, at: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = event_time(rows, at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(rows: DataFrame, at: str, by: list[str], gap: str = "1800 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions split after more than the gap: events exactly one gap apart stay together (the window's end counts in)."""
    w = event_time(rows, at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("n_rows"))
    return w.select(*by, "started_at", "ended_at", "n_rows")


def deduplicated(rows: DataFrame, at: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    return event_time(rows, at, within).dropDuplicatesWithinWatermark(keys)


def debounced(rows: DataFrame, at: str, by: list[str], quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One rebuild signal per burst: when nothing more came for ``quiet``."""
    return sessions(rows, at, by, quiet, late).select(*by, F.col("ended_at").alias("last_event"), "n_rows")


def throttled(rows: DataFrame, at: str, by: str, least_s: float, late: str = "10 seconds") -> DataFrame:
    """``by, fired_at``: of each key's events those that act: the first, and each at least ``least_s`` after the last one
    that did. The state of a key is the time it acted last; it ends once nothing could be held back by it any more."""
    wait = pd.Timedelta(seconds=least_s)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        fired = []
        for t in sorted(t for frame in frames for t in frame["at"]):
            if last is None or t - last >= wait:
                last = t
                fired.append(t)
        if last is not None:
            state.update((int(last.value // 1000),))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000 + 1000 * least_s), state.getCurrentWatermarkMs()) + 1)
        if fired:
            yield pd.DataFrame({by: [key[0]] * len(fired), "fired_at": fired})

    timed = event_time(rows.select(by, F.col(at).alias("at")), "at", late)
    kind = rows.schema[by].dataType.simpleString()
    return timed.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, fired_at timestamp", "last long", "append", "EventTimeTimeout")


def retries(outcomes: DataFrame, conf: Jobs = DEFAULTS.jobs, late: str = "10 seconds") -> DataFrame:
    """``id, attempts, status, due_at`` from a stream ``id, ok, at`` of outcomes: what each changes, and a row of status
    ``due`` when a job that failed has waited long enough, by the stream's own time.

    A job's state ends when it is done or has failed for good; an outcome that comes after that starts a new one.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        row = lambda n, status, due: pd.DataFrame({"id": [key[0]], "attempts": [n], "status": [status], "due_at": pd.Series([due], dtype="datetime64[us]")})
        attempts, due_us = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.update((attempts, 0))
            yield row(attempts, "due", pd.Timestamp(due_us, unit="us"))
            return
        status = "pending"
        for ok, at in sorted(((o, t) for frame in frames for o, t in zip(frame["ok"], frame["at"], strict=True)), key=lambda r: r[1]):
            if status != "pending":
                attempts, status = 0, "pending"
            attempts += 0 if ok else 1
            status = "done" if ok else "failed" if attempts >= conf.max_attempts else "pending"
            due = at + pd.Timedelta(seconds=conf.backoff_s * 2 ** min(attempts, conf.backoff_cap)) if status == "pending" else pd.NaT
            due_us = 0 if due is pd.NaT else int(due.value // 1000)
            yield row(attempts, status, due)
        if status != "pending":
            state.remove()
            return
        state.update((attempts, due_us))
        if due_us:
            state.setTimeoutTimestamp(max(due_us // 1000, state.getCurrentWatermarkMs() + 1))

    timed = event_time(outcomes, "at", late)
    return timed.groupBy("id").applyInPandasWithState(run, "id string, attempts long, status string, due_at timestamp", "attempts long, due_us long", "append", "EventTimeTimeout")


def queue_pass(jobs: DataFrame, fresh: DataFrame, worker: Callable[[DataFrame], DataFrame], as_of: datetime, conf: Jobs = DEFAULTS.jobs) -> DataFrame:
    """The job table after one pass: ``fresh`` jobs come in, the oldest due ones (``conf.batch`` at most) go to ``worker``,
    which gives ``id, ok, error``, and come back done, pending or failed."""
    table = insert_or_ignore(jobs, fresh, ["id"])
    return after_pass(table, worker(due(table, as_of, conf, conf.batch)), as_of, conf)


def queue(jobs: DataFrame, folder: str, worker: Callable[[DataFrame], DataFrame], checkpoint: str, now: Callable[[], datetime], conf: Jobs = DEFAULTS.jobs, **trigger: Any):
    """A durable queue over a stream of jobs: every micro-batch is one pass, whose table is written as a version of its own
    (``version=<batch>``), so that a repeated batch overwrites what it wrote and reads what was before it."""
    kind = jobs.schema

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(kind).parquet(f"{folder}/version={no - 1}") if no > 0 else spark.createDataFrame([], kind)
        queue_pass(before, batch, worker, now(), conf).select(*kind.names).write.mode("overwrite").parquet(f"{folder}/version={no}")

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scheduled(spark: SparkSession, task: Callable[[int], None], interval_s: int, checkpoint: str):
    """Runs ``task`` with a running number every ``interval_s`` seconds until the query is stopped; a number whose run was
    broken off comes again."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, no: task(no)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval_s} seconds").start()


def to_memory_sink(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end and return what it gave: for tests and small checks."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        q.processAllAvailable() if q.isActive else None
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def into_table(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]):
    """Append batches to a Parquet table, once per batch: a batch's rows lie in its own folder, which a repeated batch
    overwrites."""

    def write(batch: DataFrame, no: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
