"""Plan shapes that matter at scale, skew in the data, and the timer of the job monitor."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shotloom.operators import logs as L, review as K
from shotloom.plans import catalog
from shotloom.session import checkpoint_dir
from shotloom.sources import media as A
from shotloom.streaming import streams as X


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["nearest_beat", "energy_at", "beats_in", "beat_counts", "speech_overlap", "near_drop", "interpolate", "kernel_density", "score_candidates",
                                  "tempo_autocorr", "novelty", "snap_to_peak", "fastest_window", "bind_directives", "coverage", "conformance"])
def test_no_all_pairs_join(spark, small, name):
    logical, physical = plan_of(catalog.QUERIES[name](spark, small))
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_scores_fit_a_method_that_is_compiled(spark, small):
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # the generated code is known before the run
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = catalog.QUERIES["score_candidates"](spark, small)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000      # the JVM interprets longer methods


def test_colours_meet_centres_in_plain_columns(spark, small):
    logical, physical = plan_of(catalog.QUERIES["palette"](spark, small))
    assert "transform(" not in logical and "SortAggregate" not in physical


def test_series_are_dealt_before_their_frames_are_made(spark, small):
    _, physical = plan_of(catalog.QUERIES["novelty"](spark, small))
    assert "REPARTITION_BY_NUM" in physical


def test_summary_counts_without_arrays(spark, small):
    logical, _ = plan_of(catalog.QUERIES["qc_summary"](spark, small))
    assert "lambda" not in logical


def test_scan_reads_only_what_the_query_needs(spark, small):
    _, physical = plan_of(catalog.QUERIES["find_attributes"](spark, small))
    schema = physical.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_extendedprice" not in schema and "l_returnflag" not in schema
    _, physical = plan_of(catalog.QUERIES["needs_proxy"](spark, small))
    assert "l_discount" not in physical.split("ReadSchema: struct<")[1].split(">")[0]


def test_filter_reaches_the_scan(spark, small):
    _, physical = plan_of(catalog.QUERIES["nearest_beat"](spark, small))
    assert "EqualTo(event_type,purchase)" in physical and "EqualTo(event_type,click)" in physical


def test_hot_copies_and_users(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    f = A.with_fingerprint(d, "text").select("fingerprint", "doc_id")
    assert A.dedupe_by_content(f, "doc_id").count() == 2001
    asks = spark.range(3000).select(F.when(F.col("id") >= 0, 1).otherwise(2).alias("user_id"), F.when(F.col("id") >= 0, "fps").otherwise("x").alias("concept"), F.col("id").alias("event_id"))
    assert sorted(r.event_id for r in K.teach_limit(asks).collect()) == [0, 1]
    assert "WindowGroupLimit" in plan_of(K.teach_limit(asks))[1]
    log = spark.range(3000).select(F.lit(1).alias("job_id"), F.col("id").alias("seq"), F.when(F.col("id") == 2900, "[8] critique").otherwise("…").alias("message"))
    d = L.stage_progress(log, block=F.floor(F.col("seq") / 100))
    assert d.filter("progress = 0.8").count() == 100


def test_silent_jobs_are_interrupted(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    days = [[(1, "running", 0.1, 0), (2, "running", 0.2, 0)], [(2, "succeeded", 1.0, 600), (3, "running", 0.5, 700)], [(3, "running", 0.7, 4000)], [(3, "running", 0.8, 9000)]]
    src = str(tmp_path / "in")
    for part in days:
        spark.createDataFrame([(j, s, p, t0 + dt.timedelta(seconds=x)) for j, s, p, x in part], "job_id long, state string, progress double, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("job_id long, state string, progress double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = X.run_now(X.stream_job_monitor(stream, 3600, "0 seconds"), checkpoint_dir(spark))
    got = {(r.job_id, r.state) for r in out.collect()}
    assert (1, "interrupted") in got and (2, "succeeded") in got
    assert (2, "interrupted") not in got
