"""Streams over the event table, run to the end of what has arrived.

Closed windows only: the last ones of a stream stay open until later events push the
watermark, so the check queries leave out what the watermark has not passed.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..session import checkpoint_dir, table
from ..sources import media as A
from ..sources.snapshots import Snapshots
from ..streaming import streams as X
from .oracle import r6, sql
from .registry import query
from .search_queries import FP

c = F.col


def _source(spark, sf, name):
    """The table as a stream, be it one Parquet file or a folder of them.

    A stream refuses the plain path of a file; a pattern that only the table's own name matches stands for either.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(os.path.join(sf, f"{name}.parque[t]"))


def _events(spark, sf):
    zero = F.unix_micros(F.expr("CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' AS TIMESTAMP)"))
    d = _source(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return d.select(c("user_id").alias("series_id"), "ts", ((F.unix_micros("ts") - zero) / 1e6).alias("t"), c("value").alias("v"), c("event_type").alias("kind"), "event_id")


def _seconds(col):
    zero = F.unix_micros(F.expr("CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' AS TIMESTAMP)"))
    return (F.unix_micros(col) - zero) / 1e6


SESS = [("ss", "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) <= 43200 THEN 0 ELSE 1 END AS f FROM sig WHERE kind <> 'view'"),
        ("sg", "SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM ss"),
        ("sw", "SELECT series_id, min(t) AS a, max(t) AS b, count(*) AS k FROM sg GROUP BY series_id, g"), ("wm", "SELECT max(t) - 3600 AS w FROM sig WHERE kind <> 'view'")]


@query("stream_windows", sql(f"SELECT series_id, {r6('a')} AS w_start, {r6('b')} AS w_end, k AS samples FROM sw, wm WHERE b + 43200 <= w", *SESS))
def stream_windows(spark, sf):
    d = X.run_now(X.stream_windows(_events(spark, sf).filter("kind <> 'view'"), "12 hours", "1 hour"), checkpoint_dir(spark))
    return d.select("series_id", R(_seconds(c("w_start"))).alias("w_start"), R(_seconds(c("w_end"))).alias("w_end"), "samples")


@query("stream_energy", sql(f"""SELECT series_id, CAST(b * 43200 AS DOUBLE) AS w_start, {r6('20 * log10(sqrt(avg(v * v) + 1e-12) + 1e-9)')} AS db, count(*) AS samples FROM (
    SELECT series_id, v, unnest([CAST(floor(t / 43200) AS BIGINT), CAST(floor(t / 43200) AS BIGINT) - 1]) AS b FROM sig) GROUP BY 1, b HAVING b * 43200 + 86400 <= (SELECT max(t) - 3600 FROM sig)"""))
def stream_energy(spark, sf):
    d = X.run_now(X.stream_energy(_events(spark, sf), "1 day", "12 hours", "1 hour"), checkpoint_dir(spark))
    return d.select("series_id", _seconds(c("w_start")).alias("w_start"), R(c("db")).alias("db"), "samples")


def _arrivals(spark, sf):
    d = _source(spark, sf, "documents").select("doc_id", "text")
    return A.with_fingerprint(d, "text").select("doc_id", "fingerprint")


@query("stream_ingest", sql(f"SELECT DISTINCT {FP} AS fingerprint, 'v2' AS analysis_version FROM documents"))
def stream_ingest(spark, sf):
    root = os.path.join(checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    store = os.path.join(root, "store")
    for turn in (1, 2):     # the second run sees the same arrivals and must add nothing
        X.stream_ingest(_arrivals(spark, sf), store, "v2", os.path.join(root, f"ck{turn}")).awaitTermination()
    rows = Snapshots(spark, store, "fingerprint").read()
    if rows is None:        # no file has arrived yet
        return spark.createDataFrame([], "fingerprint string, analysis_version string")
    return rows.select("fingerprint", "analysis_version")


@query("stream_new_content", sql(f"SELECT count(DISTINCT {FP}) AS contents FROM documents"))
def stream_new_content(spark, sf):
    at = F.timestamp_seconds(c("doc_id") + 1704067200)
    d = A.with_fingerprint(_source(spark, sf, "documents").select("doc_id", "text"), "text")
    d = d.select("fingerprint", F.lit("v2").alias("analysis_version"), at.alias("ts"))
    return X.run_now(X.stream_new_content(d, "3650 days"), checkpoint_dir(spark)).agg(F.count("fingerprint").alias("contents"))


@query("stream_job_monitor")
def stream_job_monitor(spark, sf):
    e = c("event_id")
    d = _events(spark, sf).select(c("series_id").alias("job_id"), "ts", F.when(e % 131 == 0, "succeeded").when(e % 211 == 0, "failed").otherwise("running").alias("state"), F.least(c("v") / 40, F.lit(1.0)).alias("progress"))
    out = X.run_now(X.stream_job_monitor(d, 86400.0 * 5, "1 hour"), checkpoint_dir(spark))
    return out.select("job_id", "state", R(c("progress")).alias("progress"), R(_seconds(c("at"))).alias("at"))
