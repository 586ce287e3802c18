"""Series, shots, windows and clips derived from the given tables.

This is the only module that knows the column names of those tables.  Where the text
is valid on both engines the SQL below is also used by the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.blocks import TIME_BLOCK, block_of, dense_index
from ..session import stage, table

SPAN = TIME_BLOCK

# Measures of a shot, spread over plausible ranges by arithmetic on the order lines.
SHOTS_SQL = """
SELECT l_orderkey AS asset_id,
       concat_ws('_', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS shot_id,
       CAST(l_linenumber AS BIGINT) AS shot_no, l_partkey, l_suppkey,
       l_quantity / 10 AS duration,
       CAST(datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01') AS DOUBLE) * 86400 AS start,
       l_discount * 10 AS brightness,
       ((l_partkey * 13) % 100) / 100.0D AS contrast,
       ((l_partkey * 29) % 100) / 100.0D AS saturation,
       ((l_suppkey * 17 + l_partkey) % 100) / 100.0D AS colorfulness,
       ((l_partkey * 7) % 200) / 100.0D - 1 AS warmth,
       ((l_partkey * 11 + l_suppkey) % 500) / 100.0D AS flow_magnitude,
       CAST((l_partkey * 37) % 360 AS DOUBLE) AS flow_direction_deg,
       (((l_partkey * 3) % 21) - 10) / 100.0D AS zoom_rate,
       ((l_suppkey * 23 + l_partkey) % 600) / 100.0D AS shake,
       ((l_partkey * 19) % 600) / 100.0D AS subject_motion,
       ((l_partkey * 31) % 100) / 100.0D AS motion_consistency,
       ((l_suppkey * 41 + l_partkey * 3) % 100) / 100.0D AS flow_coherence,
       CAST(l_suppkey % 3 AS BIGINT) AS faces,
       CASE WHEN l_suppkey % 3 = 0 THEN 0.0D ELSE ((l_partkey * 53) % 45) / 100.0D END AS face_size_ratio,
       ((l_partkey * 61) % 100) / 100.0D AS subject_x,
       ((l_partkey * 67 + l_linenumber) % 100) / 100.0D AS subject_y,
       ((l_partkey * 5) % 20) / 400.0D AS clipped_highlights,
       ((l_partkey * 9) % 20) / 400.0D AS clipped_shadows,
       ((l_partkey * 43 + l_linenumber) % 100) / 100.0D AS sharpness,
       ((l_suppkey * 47) % 60) / 100.0D AS noise,
       ((l_partkey * 59) % 100) / 100.0D AS blockiness,
       1 - l_discount * 2 AS exposure_health,
       ((l_partkey * 71) % 100) / 100.0D AS dynamic_range,
       ((l_partkey * 79 + l_suppkey) % 100) / 100.0D AS technical_quality,
       l_tax * 12.5 AS creative_value,
       l_quantity / 50 AS visual_energy,
       CASE l_partkey % 9 WHEN 0 THEN 'static' WHEN 1 THEN 'pan_left' WHEN 2 THEN 'pan_right'
         WHEN 3 THEN 'tilt_up' WHEN 4 THEN 'tilt_down' WHEN 5 THEN 'push_in' WHEN 6 THEN 'pull_out'
         WHEN 7 THEN 'handheld' ELSE 'complex' END AS camera_movement,
       CASE WHEN l_suppkey % 3 = 0 THEN 'unknown' WHEN ((l_partkey * 53) % 45) > 28 THEN 'close_up'
         WHEN ((l_partkey * 53) % 45) > 12 THEN 'medium' ELSE 'wide' END AS shot_size,
       CASE l_suppkey % 5 WHEN 0 THEN 'use' WHEN 1 THEN 'enhance' WHEN 2 THEN 'use_briefly'
         WHEN 3 THEN 'replace' ELSE 'reject' END AS handling,
       CASE WHEN l_suppkey % 5 = 2 THEN 0.5D END AS max_useful_duration,
       CAST(320 * (1 + l_partkey % 6) AS BIGINT) AS width, CAST(180 * (1 + l_partkey % 6) AS BIGINT) AS height,
       CASE l_partkey % 4 WHEN 0 THEN 24.0D WHEN 1 THEN 25.0D WHEN 2 THEN 30.0D ELSE 60.0D END AS fps,
       CASE WHEN l_partkey % 7 = 0 THEN 0.0D ELSE (l_partkey % 50) * 200000.0D END AS bitrate
FROM {lineitem}
"""


def spark_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run view text with ``{table}`` markers bound to the given parquet tables."""
    import re

    for name in set(re.findall(r"\{(\w+)\}", text)) - set(frames):
        frames[name] = table(spark, sf_dir, name)
    return spark.sql(text, **frames)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t``, seconds from 2024-01-01.  The source column has no zone."""
    zero = F.unix_micros(F.expr("CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' AS TIMESTAMP)"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").withColumn("t", (at - zero) / F.lit(1e6))


def series(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """One series per user: position ``n``, time ``t``, value ``v``, ``kind``, ``event_id``.

    ``stored`` writes the indexed table once, for queries that visit it several times.
    """
    ev = events(spark, sf_dir).select(F.col("user_id").alias("series_id"), "t", F.col("value").alias("v"),
                                      F.col("event_type").alias("kind"), "event_id")
    out = dense_index(ev, ["series_id"], ["t", "event_id"], block_of(F.col("t"), SPAN))
    return stage(out) if stored else out


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``series`` without the position, for operators that order by time alone."""
    return events(spark, sf_dir).select(F.col("user_id").alias("series_id"), "t", F.col("value").alias("v"),
                                        F.col("event_type").alias("kind"), "event_id")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, SHOTS_SQL)


def _of_kind(spark, sf_dir, kind):
    return raw_series(spark, sf_dir).filter(F.col("kind") == kind)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_kind(spark, sf_dir, "click").select("series_id", F.col("t").alias("beat"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_kind(spark, sf_dir, "purchase").select("series_id", "event_id", F.col("t").alias("cut"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_kind(spark, sf_dir, "signup").select(
        "series_id", F.col("t").alias("w_start"), (F.col("t") + F.col("v") * 60).alias("w_end"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_kind(spark, sf_dir, "purchase").select(
        "series_id", F.col("event_id").alias("clip_id"), F.col("t").alias("c_in"), (F.col("t") + 3600).alias("c_out"))
