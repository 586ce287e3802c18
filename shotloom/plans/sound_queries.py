"""Mix plans and delivery checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import sound as M
from ..rules.delivery import PROFILES
from ..session import table
from ..sources import views as V
from .join_queries import OVERLAP
from .oracle import r6, sql
from .registry import query

c = F.col


@query("voice_tracks", sql(f"SELECT series_id, clip_id, {r6('overlap')} AS overlap, printf('%.1fs of detected speech in this clip''s own audio', overlap) AS reason FROM ov WHERE overlap >= 0.25", OVERLAP))
def voice_tracks(spark, sf):
    return M.voice_tracks(V.clips(spark, sf), V.windows(spark, sf)).select("series_id", "clip_id", R(c("overlap")).alias("overlap"), "reason")


def _mix(spark, sf):
    lines = V.shots(spark, sf).withColumn("timeline_id", c("asset_id"))
    voices = lines.select("timeline_id", c("start").alias("tl_start"), c("shake").alias("source_in"), (c("shake") + c("duration") - c("noise") * 15).alias("source_out"))
    k = c("o_orderkey")
    tl = table(spark, sf, "orders").select(k.alias("timeline_id"), (k % 40 + 1.0).alias("duration"), (k % 9 / 4.0).alias("continuity_weight"), (k % 7 / 5.0).alias("pacing_multiplier"),
                                             F.when(k % 6 == 0, 40.0).alias("music_gain_db"))
    return M.plan_mix(tl, voices)


MIX = [
    ("vc", """SELECT asset_id AS timeline_id, 'vox' || lpad(CAST(row_number() OVER (PARTITION BY asset_id ORDER BY start, shake) - 1 AS VARCHAR), 2, '0') AS track_id, shake AS source_in, shake + duration - noise * 15 AS source_out
        FROM shots"""),
    ("mx", """SELECT o_orderkey AS timeline_id, o_orderkey % 40 + 1.0 AS duration, o_orderkey % 9 / 4.0 AS cw, o_orderkey % 7 / 5.0 AS pm, CASE WHEN o_orderkey % 6 = 0 THEN 40.0 ELSE 0 END AS mg,
        o_orderkey IN (SELECT timeline_id FROM vc) AS hv FROM orders"""),
    ("pl", """SELECT *, CASE WHEN hv THEN least(greatest(9 + CASE WHEN cw > 1.5 THEN 3 ELSE 0 END - CASE WHEN pm < 0.8 THEN 2 ELSE 0 END, 3), 18) ELSE 6 END AS depth FROM mx"""),
]


def threshold_sql(x: str) -> str:
    d = f"least(greatest({x}, 0), 6.9)"
    return f"""CASE WHEN {d} <= 2.6 THEN least(0.2, 0.045 * 2.6 / greatest({d}, 0.5))
      WHEN {d} <= 6.5 THEN round(power(10, log10(0.045) + ({d} - 2.6) / (6.5 - 2.6) * (log10(0.010) - log10(0.045))), 5)
      ELSE round(power(10, log10(0.010) + ({d} - 6.5) / (6.9 - 6.5) * (log10(0.003) - log10(0.010))), 5) END"""


@query("plan_mix", sql(f"""SELECT timeline_id, track_id, role, {r6('g')} AS gain_db, {r6('fo')} AS fade_out FROM (
    SELECT timeline_id, track_id, 'voice' AS role, 0.0::DOUBLE AS g, 0.0::DOUBLE AS fo FROM vc WHERE timeline_id IN (SELECT timeline_id FROM vc)
    UNION ALL SELECT timeline_id, 'music', 'music', CASE WHEN hv THEN -10 ELSE 0 END + mg, least(greatest(duration * 0.06, 0.4), 1.2) FROM mx)""", *MIX[:2]))
def plan_mix(spark, sf):
    return _mix(spark, sf)[0].select("timeline_id", "track_id", "role", R(c("gain_db")).alias("gain_db"), R(c("fade_out")).alias("fade_out"))


@query("mix_settings", sql(f"SELECT timeline_id, {r6('depth')} AS duck_depth_db, {r6('least(depth, 6.9)')} AS achievable_db, {r6(threshold_sql('depth'))} AS threshold FROM pl", *MIX))
def mix_settings(spark, sf):
    return _mix(spark, sf)[2].select("timeline_id", *[R(c(x)).alias(x) for x in ("duck_depth_db", "achievable_db", "threshold")])


@query("duck_threshold", sql(f"SELECT shot_id, {r6(threshold_sql('duration * 2'))} AS threshold FROM shots"))
def duck_threshold(spark, sf):
    return V.shots(spark, sf).select("shot_id", R(M.duck_threshold(c("duration") * 2)).alias("threshold"))


@query("validate_mix", sql("""SELECT timeline_id, track_id AS subject, 'empty_range' AS code FROM vc WHERE source_out <= source_in
    UNION ALL SELECT timeline_id, 'music', 'gain_range' FROM mx WHERE CASE WHEN hv THEN -10 ELSE 0 END + mg > 24
    UNION ALL SELECT timeline_id, 'music', 'unknown_duck' FROM pl WHERE timeline_id % 10 = 0 AND hv
    UNION ALL SELECT timeline_id, '', 'duplicate_ids' FROM vc WHERE timeline_id % 8 = 0 AND track_id = 'vox00'
    UNION ALL SELECT timeline_id, '', 'duck_depth' FROM pl WHERE timeline_id % 5 = 0
    UNION ALL SELECT timeline_id, track_id, 'empty_range' FROM vc WHERE timeline_id % 8 = 0 AND track_id = 'vox00' AND source_out <= source_in""", *MIX))
def validate_mix(spark, sf):
    tracks, ducks, plans = _mix(spark, sf)
    twice = tracks.filter("timeline_id % 8 = 0 AND track_id = 'vox00'")
    odd = ducks.filter("timeline_id % 10 = 0 AND by_id = 'vox00'").withColumn("by_id", F.lit("ghost"))
    plans = plans.withColumn("duck_depth_db", F.when(c("timeline_id") % 5 == 0, 40.0).otherwise(c("duck_depth_db")))
    return M.validate_mix(tracks.unionByName(twice), ducks.unionByName(odd), plans)


PROF = ("pf", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {w}, {h}, {f}::DOUBLE, {-23.0 if t == 'broadcast' else -14.0}::DOUBLE, {'NULL' if m is None else m}::DOUBLE)" for n, w, h, f, t, m in PROFILES) + ") v(profile, pw, ph, pf, lt, md)")
MEDIA = ("md0", """SELECT *, duration * 60 AS secs, l_partkey % 4 <> 0 AS has_audio, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE -14.0 - warmth END AS loud, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE -1.5 + noise END AS tp,
    CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_partkey % 3 <> 0 END AS fast FROM shots""")


def media(spark, sf):
    k = c("l_partkey")
    return V.shots(spark, sf).withColumns({
        "file_id": c("shot_id"), "duration": c("duration") * 60, "has_audio": k % 4 != 0, "codec": F.when(k % 9 == 0, "hevc").otherwise("h264"), "pix_fmt": F.lit("yuv420p"),
        "sample_rate": F.when(k % 2 == 0, 48000).otherwise(44100), "channels": F.lit(2), "loudness": F.when(k % 5 != 0, -14.0 - c("warmth")),
        "true_peak": F.when(k % 6 != 0, -1.5 + c("noise")), "faststart": F.when(k % 8 != 0, k % 3 != 0)})


@query("plan_scaling", sql(f"SELECT shot_id AS file_id, profile, {r6('least(pw / width, ph / height)')} AS factor, least(pw / width, ph / height) > 1.01 AS upscaling FROM shots CROSS JOIN pf", PROF))
def plan_scaling(spark, sf):
    return M.plan_scaling(V.shots(spark, sf)).select(c("shot_id").alias("file_id"), "profile", R(c("factor")).alias("factor"), "upscaling")


def _ck(name, ok, when="true", skip="false"):
    return f"SELECT shot_id AS file_id, profile, '{name}' AS name, CASE WHEN {skip} THEN 'skip' WHEN {ok} THEN 'pass' ELSE 'fail' END AS status FROM md0 CROSS JOIN pf WHERE {when}"


CHECKS = ("ck", " UNION ALL ".join([
    _ck("resolution", "width = pw AND height = ph"), _ck("frame rate", "abs(fps - pf) <= 0.05"), _ck("video codec", "l_partkey % 9 <> 0"), _ck("pixel format", "true"),
    _ck("audio stream", "has_audio"), _ck("sample rate", "l_partkey % 2 = 0", "has_audio"), _ck("channels", "true", "has_audio"), _ck("duration limit", "secs <= md + 0.05", "md IS NOT NULL"),
    _ck("loudness", "abs(loud - lt) <= 1.0", "has_audio", "loud IS NULL"), _ck("true peak", "tp <= -1.0", "has_audio", "tp IS NULL"), _ck("faststart", "fast", "true", "fast IS NULL"),
    _ck("resolution provenance", "true", "least(pw / width, ph / height) > 1.01", "true")]))


@query("conformance", sql("SELECT profile, name, status, count(*) AS files FROM ck GROUP BY 1, 2, 3", PROF, MEDIA, CHECKS))
def conformance(spark, sf):
    d = M.qc_rows(M.conformance(media(spark, sf)))
    return d.groupBy("profile", c("check").alias("name"), "status").agg(F.count(F.lit(1)).alias("files"))


@query("qc_summary", sql("""SELECT file_id, profile, count(CASE WHEN status = 'pass' THEN 1 END) AS passed, count(CASE WHEN status = 'fail' THEN 1 END) AS failed, count(CASE WHEN status = 'skip' THEN 1 END) AS skipped,
    count(CASE WHEN status = 'fail' THEN 1 END) = 0 AS conformant FROM ck GROUP BY 1, 2""", PROF, MEDIA, CHECKS))
def qc_summary(spark, sf):
    return M.qc_summary(M.conformance(media(spark, sf)))
