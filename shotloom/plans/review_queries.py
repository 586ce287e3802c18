"""Reviews of edits, candidate choice and shot-plan coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import review as K, timeline as T
from ..operators.search import Criterion as C
from ..rules.delivery import CONCEPTS, SHOT_SPECS
from ..session import stage, table
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .series_queries import SCORE
from .style_queries import CURVE, PTS, _samples
from .timeline_queries import METRIC, TL, timeline

c = F.col


@query("beat_alignment", sql(f"""SELECT series_id, {r6('err')} AS mean_error, {r6('least(greatest(1 - err / 86400.0, 0), 1)')} AS alignment, err > 43200.0 AS beat_drift FROM (
    SELECT series_id, avg(e) AS err FROM (SELECT c.series_id, c.event_id, min(abs(b.beat - c.cut)) AS e FROM cuts c JOIN beats b USING (series_id) GROUP BY 1, 2) GROUP BY 1)"""))
def beat_alignment(spark, sf):
    d = K.beat_alignment(V.cuts(spark, sf), V.beats(spark, sf), scale=86400.0, drift=43200.0)
    return d.select("series_id", R(c("mean_error")).alias("mean_error"), R(c("alignment")).alias("alignment"), "beat_drift")


PR = ("pr", """SELECT *, detected / greatest(planned, 1) AS vis, clips / duration AS cps, tc / pmu AS goal, clips / duration / (tc / pmu) AS r FROM (
    SELECT l_suppkey AS timeline_id, count(*) AS clips, count(*) - 1 AS planned, count(CASE WHEN l_partkey % 4 <> l_suppkey % 5 THEN 1 END) AS detected, sum(duration) AS duration, 0.1 + (l_suppkey % 9) / 8.0 AS tc, 0.5 + (l_suppkey % 4) / 2.0 AS pmu FROM shots GROUP BY l_suppkey)""")


@query("pacing_review", sql(f"""SELECT timeline_id, {r6('vis')} AS visibility, {r6('cps - goal')} AS pacing_error, vis < 0.75 AS indistinct, CASE WHEN r < 0.62 THEN 'too_slow' WHEN r > 1.6 THEN 'too_fast' END AS pacing_issue,
    {r6('CASE WHEN r < 0.62 THEN least(1.7, 1 / r) WHEN r > 1.6 THEN greatest(0.6, 1 / r) END')} AS factor FROM pr""", PR))
def pacing_review(spark, sf):
    k = c("l_suppkey")
    t = V.shots(spark, sf).groupBy(k.alias("timeline_id")).agg(F.count(F.lit(1)).alias("clips"), F.count(F.when(c("l_partkey") % 4 != k % 5, 1)).alias("detected"), F.sum("duration").alias("duration"))
    k = c("timeline_id")
    t = t.withColumns({"planned": c("clips") - 1, "target_cps": 0.1 + (k % 9) / 8.0, "pacing_multiplier": 0.5 + (k % 4) / 2.0})
    d = K.pacing_review(t)
    return d.select("timeline_id", R(c("visibility")).alias("visibility"), R(c("pacing_error")).alias("pacing_error"), "indistinct", "pacing_issue", R(c("factor")).alias("factor"))


@query("luma_jumps", sql(f"""SELECT series_id, {r6('avg(j)')} AS mean_jump, count(*) AS cuts, count(CASE WHEN j > 62 THEN 1 END) AS harsh, count(CASE WHEN j > 62 THEN 1 END) > greatest(1, count(*) * 0.3) AS harsh_issue FROM (
    SELECT q.series_id, q.event_id, j, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(r.t - q.cut), r.t) AS k FROM (SELECT series_id, event_id, cut + 1800 AS cut FROM cuts) q
    JOIN (SELECT series_id, t, abs(lead(v * 12, 2) OVER w - lag(v * 12, 2) OVER w) AS j FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY n)) r USING (series_id)) WHERE k = 1 AND j IS NOT NULL GROUP BY 1"""))
def luma_jumps(spark, sf):
    q = V.cuts(spark, sf).withColumn("cut", c("cut") + 1800)
    d = K.luma_jumps(q, V.series(spark, sf, stored=True).withColumn("luma", c("v") * 12))
    return d.select("series_id", R(c("mean_jump")).alias("mean_jump"), "cuts", "harsh", "harsh_issue")


@query("intensity_tracking", sql(f"""SELECT series_id, {r6('avg(x) * 10')} AS intensity_realized, {r6('avg(abs(x - g))')} AS tracking_error, avg(abs(x - g)) > 0.3 AS mismatch FROM (
    SELECT *, [0.2, 0.5, 0.9, 0.7][CAST(floor(n / {PTS - 1}.0::DOUBLE * 3) AS INT) + 1] AS g FROM mx) GROUP BY 1""", SCORE, *CURVE[:-2]))
def intensity_tracking(spark, sf):
    sig = V.raw_series(spark, sf)
    dur = sig.groupBy("series_id").agg(F.max("t").alias("duration"))
    goal = F.array(*[F.lit(x) for x in (0.2, 0.5, 0.9, 0.7)])
    d = K.intensity_tracking(V.cuts(spark, sf), _samples(spark, sf), dur, goal, PTS, start="cut", sigma=86400.0)
    return d.select("series_id", R(c("intensity_realized")).alias("intensity_realized"), R(c("tracking_error")).alias("tracking_error"), "mismatch")


@query("finish_review", sql(f"""SELECT timeline_id, {r6('avg(len(fx))')} AS effects_per_clip, {r6('stddev_pop(sharpness) / avg(sharpness)')} AS sharpness_cv, {r6('stddev_pop(brightness * 255)')} AS brightness_std,
    avg(len(fx)) > 1.2 + 3.2 * 0.05 AND 0.05 < 0.6 AS over_processed, stddev_pop(sharpness) / avg(sharpness) > 1.15 AS quality_inconsistent, stddev_pop(brightness * 255) > 55 AS exposure_inconsistent FROM tl GROUP BY 1""", TL))
def finish_review(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "effects", "sharpness", (c("brightness") * 255).alias("brightness")))
    d = K.finish_review(t, t, F.lit(0.05))
    return d.select("timeline_id", R(c("effects_per_clip")).alias("effects_per_clip"), R(c("sharpness_cv")).alias("sharpness_cv"), R(c("brightness_std")).alias("brightness_std"), "over_processed", "quality_inconsistent", "exposure_inconsistent")


@query("critique_score", sql(f"""SELECT o.o_orderkey AS timeline_id, coalesce(k, 0) AS issues, {r6('least(greatest(6.5 + 2.2 * (o.o_orderkey % 10) / 10.0 - coalesce(p, 0), 0), 10)')} AS score FROM orders o LEFT JOIN (
    SELECT l_orderkey, count(*) AS k, sum(CASE l_partkey % 3 WHEN 0 THEN 1.8 WHEN 1 THEN 1.0 ELSE 0.4 END) AS p FROM lineitem GROUP BY 1) i ON i.l_orderkey = o.o_orderkey"""))
def critique_score(spark, sf):
    """Every order a timeline, every line of it an issue."""
    k = c("o_orderkey")
    t = table(spark, sf, "orders").select(k.alias("timeline_id"), ((k % 10) / 10.0).alias("alignment"))
    i = table(spark, sf, "lineitem").select(c("l_orderkey").alias("timeline_id"), F.when(c("l_partkey") % 3 == 0, "high").when(c("l_partkey") % 3 == 1, "medium").otherwise("low").alias("severity"))
    return K.critique_score(t, i).select("timeline_id", "issues", R(c("score")).alias("score"))


@query("choose_candidate", sql(f"""SELECT run_id, winner, {r6('s1')} AS score, {r6('s1 - low')} AS spread, {r6('coalesce(s1 - s2, 0)')} AS margin, coalesce(s1 - s2, 0) >= 0.5 AS decisive, viable FROM (
    SELECT asset_id AS run_id, max(CASE WHEN r = 1 THEN shot_id END) AS winner, max(s) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2, min(s) AS low, count(*) AS viable FROM (
      SELECT asset_id, shot_id, technical_quality * 10 AS s, row_number() OVER (PARTITION BY asset_id ORDER BY technical_quality * 10 DESC, shot_id) AS r FROM shots WHERE handling <> 'reject') GROUP BY 1)"""))
def choose_candidate(spark, sf):
    d = V.shots(spark, sf).select(c("asset_id").alias("run_id"), c("shot_id").alias("name"), (c("technical_quality") * 10).alias("score"), F.when(c("handling") == "reject", "failed").alias("error"))
    d = K.choose_candidate(d)
    return d.select("run_id", "winner", R(c("score")).alias("score"), R(c("spread")).alias("spread"), R(c("margin")).alias("margin"), "decisive", "viable")


@query("ab_compare", sql(f"""SELECT timeline_id, metric, {r6('a')} AS a, {r6('b')} AS b, passed FROM (
    SELECT x.timeline_id, unnest(['mean_shot', 'clips', 'cuts_per_second', 'showy_share']) AS metric, unnest([x.mean_shot, x.clips, x.clips / x.duration, x.sh / (x.clips - 1)]) AS a, unnest([y.mean_shot, y.clips, y.clips / y.duration, y.sh / (y.clips - 1)]) AS b,
      unnest([x.mean_shot > y.mean_shot * 1.25, x.clips < y.clips * 0.85, x.clips / x.duration < y.clips / y.duration * 0.85, x.sh / (x.clips - 1) < y.sh / (y.clips - 1)]) AS passed
    FROM mt x JOIN mt y ON y.timeline_id = x.timeline_id + 1)""", TL, METRIC))
def ab_compare(spark, sf):
    m = stage(T.timeline_metrics(timeline(spark, sf)).select("timeline_id", "mean_shot", "clips", "cuts_per_second", "showy_share"))
    s = F.struct("mean_shot", "clips", "cuts_per_second", "showy_share")
    d = K.ab_compare(m.select("timeline_id", s.alias("restrained")).join(m.select((c("timeline_id") - 1).alias("timeline_id"), s.alias("chaotic")), "timeline_id"))
    return d.select("timeline_id", "metric", R(c("a")).alias("a"), R(c("b")).alias("b"), "passed")


STATIC = C("camera_movement", "==", "static", "camera movement is static")
MOVING = C("subject_motion", ">", 3.0, "subject motion above 3.0")
LIVELY = C("visual_energy", ">", 0.6, "visual energy above 0.6")
SPECS = (
    {"number": 1, "criteria": (STATIC,), "duration": 2.5}, {"number": 2, "criteria": (STATIC, C("sharpness", ">", 60.0, "sharpness above 60")), "duration": 1.5},
    {"number": 3, "criteria": (LIVELY, MOVING), "duration": 30.0}, {"number": 4, "criteria": (C("framing", "==", "wide", "shot size is wide"),), "duration": 3.0},
    {"number": 5, "criteria": (), "duration": 3.0})


def _top5(n, tests, need):
    met = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)
    return f"""SELECT '{n}' AS query_id, shot_id, score, r, score >= 0.999 AND duration >= {need} AS good FROM (SELECT *, row_number() OVER (ORDER BY score DESC, technical_quality DESC, shot_id) AS r FROM (
      SELECT *, ({met}) / {len(tests)}.0::DOUBLE AS score FROM shots WHERE handling <> 'reject') WHERE score > 0) WHERE r <= 5"""


COVERED = f"""SELECT p.query_id, CASE WHEN checked = 0 THEN 'unverifiable' WHEN coalesce(g, 0) = 0 THEN 'missing' ELSE 'likely' END AS status, checked, {r6('coalesce(near, 0)')} AS closest, coalesce(names, '') AS candidates FROM
    (VALUES ('1', 1::BIGINT), ('2', 2::BIGINT), ('3', 2::BIGINT), ('4', 0::BIGINT), ('5', 0::BIGINT)) p(query_id, checked) LEFT JOIN (
      SELECT query_id, max(score) AS near, count(CASE WHEN good THEN 1 END) AS g, array_to_string((list(shot_id ORDER BY r) FILTER (good))[1:3], ',') AS names FROM (
        {_top5(1, ["camera_movement = 'static'"], 'greatest(0.3, 2.5 / 3 * 0.6)')} UNION ALL {_top5(2, ["camera_movement = 'static'", "sharpness > 60"], 'greatest(0.3, 1.5 / 3 * 0.6)')}
        UNION ALL {_top5(3, ["visual_energy > 0.6", "subject_motion > 3.0"], 'greatest(0.3, 30.0 / 3 * 0.6)')}
        UNION ALL SELECT '4', shot_id, 1.0, r, false FROM (SELECT shot_id, row_number() OVER (ORDER BY technical_quality DESC, shot_id) AS r FROM shots WHERE handling <> 'reject') WHERE r = 1) GROUP BY 1) x ON x.query_id = p.query_id"""


@query("coverage", sql(COVERED))
def coverage(spark, sf):
    d = K.coverage(V.shots(spark, sf).withColumn("framing", F.lit("unknown")), SPECS)
    return d.select("query_id", "status", "checked", R(c("closest")).alias("closest"), F.array_join("candidates", ",").alias("candidates"))


@query("coverage_summary", sql(f"""SELECT count(*) FILTER (status = 'likely') AS likely, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unverifiable') AS unverifiable,
    count(*) FILTER (status = 'missing') = 0 AS ready FROM ({COVERED})"""))
def coverage_summary(spark, sf):
    return K.coverage_summary(K.coverage(V.shots(spark, sf).withColumn("framing", F.lit("unknown")), SPECS))


@query("inspect_recording", sql("""SELECT shot_id, CASE WHEN handling IN ('reject', 'use_briefly') OR problems <> '' OR short THEN 'reshoot' ELSE 'approve' END AS verdict, problems,
    array_to_string(list_filter([CASE WHEN handling = 'reject' THEN 'technically unusable' WHEN handling = 'use_briefly' THEN 'usable only briefly' WHEN problems <> '' THEN 'does not match the direction: ' || problems END,
      CASE WHEN short THEN 'too short' END], lambda x: x IS NOT NULL), ' | ') AS advice FROM (
    SELECT *, CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN camera_movement = 'static' THEN '' ELSE 'camera movement is static' END
      ELSE array_to_string(list_filter([CASE WHEN visual_energy > 0.6 THEN NULL ELSE 'visual energy above 0.6' END, CASE WHEN subject_motion > 3 THEN NULL ELSE 'subject motion above 3.0' END], lambda x: x IS NOT NULL), '; ') END AS problems,
      duration < CASE WHEN l_partkey % 2 = 0 THEN greatest(0.3, 2.5 / 3 * 0.6) ELSE greatest(0.3, 30.0 / 3 * 0.6) END AS short FROM shots)"""))
def inspect_recording(spark, sf):
    d = V.shots(spark, sf).withColumn("spec", F.when(c("l_partkey") % 2 == 0, 1).otherwise(3))
    d = K.inspect_recording(d, SPECS)
    return d.select("shot_id", "verdict", F.array_join("problems", "; ").alias("problems"), F.array_join("advice", " | ").alias("advice"))


@query("instantiate_specs", sql(f"""SELECT p_partkey AS style_id, number, name, {r6('round_even(greatest(f, cut * 3 + 1), 1)')} AS record_seconds FROM (SELECT *, hi - (hi - lo) * i AS cut FROM (SELECT *, greatest(lo + 0.05, CASE WHEN p90 = 0 THEN 1.2 ELSE p90 END) AS hi FROM (
    SELECT p_partkey, number, name, i, f, greatest(0.12, CASE WHEN p10 = 0 THEN 0.3 ELSE p10 END) AS lo, p90 FROM (SELECT p_partkey, (p_size % 10) / 7.0::DOUBLE AS p10, p_size / 13.0::DOUBLE AS p90 FROM part)
    CROSS JOIN (VALUES {", ".join(f"({n}::BIGINT, '{name}', {i}::DOUBLE, {f}::DOUBLE)" for s, n, name, i, f, _, _ in SHOT_SPECS if s == 'skill')}) v(number, name, i, f))))"""))
def instantiate_specs(spark, sf):
    s = table(spark, sf, "part").select(c("p_partkey").alias("style_id"), ((c("p_size") % 10) / 7.0).alias("p10_shot"), (c("p_size") / 13.0).alias("p90_shot"))
    return K.instantiate_specs(s, "skill").select("style_id", "number", "name", R(c("record_seconds")).alias("record_seconds"))


@query("teach_limit", sql("""SELECT series_id AS user_id, concept, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY series_id, concept ORDER BY event_id) AS nth FROM (
    SELECT *, ['fps', 'pre_post_roll', 'low_angle', 'headroom', 'handheld', 'locked_off', 'tracking', 'white_balance', 'bokeh', NULL][CAST(event_id % 10 AS INT) + 1] AS concept FROM sig)
    WHERE concept NOT IN ('fps', 'bokeh') AND series_id % 10 <> 0) WHERE nth <= 2"""))
def teach_limit(spark, sf):
    d = V.raw_series(spark, sf).select(c("series_id").alias("user_id"), F.get(F.array(*[F.lit(x) for x in (*CONCEPTS, "bokeh", None)]), (c("event_id") % 10).cast("int")).alias("concept"), "event_id",
                                       F.when(c("series_id") % 10 == 0, "minimal").otherwise("normal").alias("level"))
    known = d.select("user_id").distinct().withColumn("concept", F.lit("fps"))
    return K.teach_limit(d, known).select("user_id", "concept", "event_id", c("nth").cast("long").alias("nth"))


@query("revision_knobs", sql(f"""SELECT timeline_id, {r6('coalesce(1 / (arg_min(f, o) FILTER (a = 0)), 1) * coalesce(1 / (arg_min(f, o) FILTER (a = 1)), 1)')} AS pacing_bias,
    CASE WHEN count(*) FILTER (a = 2) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS diversity_step FROM (SELECT series_id AS timeline_id, event_id AS o, event_id % 3 AS a, 1 + v / 50 AS f FROM sig) GROUP BY 1"""))
def revision_knobs(spark, sf):
    a = c("event_id") % 3
    d = V.raw_series(spark, sf).select(c("series_id").alias("timeline_id"), c("event_id").alias("ord"), (1 + c("v") / 50).alias("factor"),
                                                     F.when(a == 0, "increase_cut_density").when(a == 1, "decrease_cut_density").otherwise("increase_visual_contrast").alias("action"))
    return K.revision_knobs(d).select("timeline_id", R(c("pacing_bias")).alias("pacing_bias"), "diversity_step")


@query("duration_drift", sql(f"""SELECT t.timeline_id, {r6('t.duration - 1500')} AS drift, t.timeline_id IN (SELECT l_suppkey FROM shots WHERE l_partkey % 1999 = 0) AS by_directive FROM mt t WHERE abs(t.duration - 1500) > 30""", TL, METRIC))
def duration_drift(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "tl_start", "dur", "l_partkey"))
    m = t.groupBy("timeline_id").agg(F.max(c("tl_start") + c("dur")).alias("duration")).withColumn("target", F.lit(1500.0))
    d = K.duration_drift(m, t.filter("l_partkey % 1999 = 0").withColumn("kind", F.lit("set_duration")), least=30.0)
    return d.select("timeline_id", R(c("drift")).alias("drift"), "by_directive")

