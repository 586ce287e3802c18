"""Streaming forms of the window, ingest, level and job-monitor operators.

Event times are TIMESTAMP columns; a column without a zone has to be cast before it
enters a stream.  State is keyed by series or job, bounded by the watermark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..rules.delivery import TERMINAL
from ..sources.media import pending_analysis
from ..sources.snapshots import Snapshots

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_windows(samples: DataFrame, gap: str, lateness: str, keys=("series_id",), ts: str = "ts") -> DataFrame:
    """Active samples merged into windows as they arrive.

    Samples at most ``gap`` apart share a window; the session end lies one gap after the last
    sample, so it is taken off again.  Closed windows are emitted once the watermark passes.
    """
    d = samples.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("samples"))
    return d.select(*keys, F.col("_w.start").alias("w_start"), (F.col("_w.end") - F.expr(f"INTERVAL {gap}")).alias("w_end"), "samples")


def stream_energy(samples: DataFrame, size: str, slide: str, lateness: str, keys=("series_id",), ts: str = "ts", value: str = "v") -> DataFrame:
    """Level per sliding time window in decibels."""
    d = samples.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, size, slide).alias("_w"))
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12)
    return d.agg((20 * F.log10(rms + 1e-9)).alias("db"), F.count(F.lit(1)).alias("samples")).select(*keys, F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"), "db", "samples")


def stream_new_content(arrivals: DataFrame, lateness: str, ts: str = "ts") -> DataFrame:
    """First arrival of every (fingerprint, analysis version) within the watermark."""
    return arrivals.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["fingerprint", "analysis_version"])


def stream_ingest(arrivals: DataFrame, store: str, version: str, checkpoint: str, analyse=None) -> StreamingQuery:
    """Analyse only content not stored yet under this version, batch by batch.

    ``store`` holds the results as ``Snapshots`` by fingerprint: a batch reads the fingerprints of its own buckets, and its
    results become visible as a whole.  A batch repeated after a failure replaces its own earlier output (by run, named after
    ``checkpoint``, and batch number); batches of other runs are never touched.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, number: int) -> None:
        table, token = Snapshots(batch.sparkSession, store, "fingerprint"), f"{run}-{number}"
        fresh = batch.dropDuplicates(["fingerprint"])
        done = table.read(table.buckets_of(fresh), without=token)
        if done is None:
            done = batch.sparkSession.createDataFrame([], "fingerprint string, analysis_version string")
        todo = pending_analysis(fresh, done.select("fingerprint", "analysis_version"), version).withColumn("analysis_version", F.lit(version))
        table.append(todo if analyse is None else analyse(todo), token)

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MONITOR_SCHEMA = StructType([StructField("job_id", LongType()), StructField("state", StringType()), StructField("progress", DoubleType()), StructField("at", TimestampType())])


class JobMonitor(StatefulProcessor):
    """Latest state per job; a job silent for ``timeout_ms`` of event time is reported as interrupted.

    A job that has ended is remembered for ``keep_ms`` of event time, in which later events of it
    are ignored; then its state is dropped.
    """

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("state", StringType()), StructField("progress", DoubleType()), StructField("at", TimestampType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        if old is not None and old[0] in TERMINAL:
            for _ in rows:
                pass
            return
        d = pd.concat(list(rows)).sort_values("ts", kind="stable")
        ends = d[d["state"].isin(TERMINAL)]
        row = ends.iloc[0] if len(ends) else d.iloc[-1]
        at = row["ts"].to_pydatetime()
        if old is not None and not len(ends) and old[2] is not None and pd.Timestamp(old[2]) > pd.Timestamp(at):
            return
        self.last.update((str(row["state"]), float(row["progress"]), at))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wait = self.keep_ms if row["state"] in TERMINAL else self.timeout_ms
        self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + wait)
        yield pd.DataFrame({"job_id": [key[0]], "state": [row["state"]], "progress": [float(row["progress"])], "at": [at]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, progress, at = self.last.get()
        if state in TERMINAL:
            self.last.clear()
            return
        self.last.update(("failed", progress, at))
        self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.timeout_ms + self.keep_ms)
        yield pd.DataFrame({"job_id": [key[0]], "state": ["interrupted"], "progress": [progress], "at": [at]})

    def close(self) -> None:
        pass


def stream_job_monitor(events: DataFrame, timeout_seconds: float, lateness: str, key: str = "job_id", ts: str = "ts", keep_seconds: float = 30 * 86400.0) -> DataFrame:
    """State changes of jobs (job_id, state, progress, ts); needs the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    d = events.withWatermark(ts, lateness)
    return d.groupBy(key).transformWithStateInPandas(JobMonitor(int(timeout_seconds * 1000), int(keep_seconds * 1000)), MONITOR_SCHEMA, "Append", "EventTime")


def run_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived, into a Parquet table, and return that table."""
    import os
    import uuid
    out, ck = os.path.join(folder, f"out-{uuid.uuid4().hex}"), os.path.join(folder, f"ck-{uuid.uuid4().hex}")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
