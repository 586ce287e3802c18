"""Edit profiles over the cut series and style blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..functions.scores import light_key
from ..operators import style as G
from ..operators.blocks import block_of, dense_index, neighbours
from ..session import stage
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .series_queries import SCORE, mirror_sql

c = F.col
# events played as an edit: a day is a second, and an edit ends with the day of its series' last event
ENDS = ("ends", "SELECT series_id, floor(max(t) / 86400) + 1.0 AS len FROM sig GROUP BY 1")

EDIT = [ENDS, ("e0", "SELECT DISTINCT series_id, 0.0::DOUBLE AS s FROM cuts UNION ALL SELECT series_id, cut / 86400 FROM cuts"),
        ("edit", """SELECT series_id AS style_id, row_number() OVER w - 1 AS idx, s, coalesce(lead(s) OVER w, len) AS e,
            coalesce(lead(s) OVER w, len) - s AS d, len FROM e0 JOIN ends USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY s)""")]


def ends(spark, sf):
    return V.raw_series(spark, sf).groupBy("series_id").agg((F.floor(F.max("t") / 86400) + 1.0).alias("duration"))


def edit(spark, sf):
    cuts = V.cuts(spark, sf)
    starts = cuts.select(c("series_id").alias("style_id"), (c("cut") / 86400).alias("start"))
    starts = starts.unionByName(starts.select("style_id", F.lit(0.0).alias("start")).distinct())
    d = neighbours(starts, ["style_id"], ["start"], block_of(c("start"), 1.0), c("start"), nxt="end")
    d = d.join(ends(spark, sf).withColumnRenamed("series_id", "style_id"), "style_id")
    d = dense_index(d.withColumn("end", F.coalesce("end", "duration")), ["style_id"], ["start"], block_of(c("start"), 1.0), "idx")
    return stage(d)


def lengths_of(shots, key="style_id"):
    return shots.select(key, "duration").distinct()


PACE = ("pace", """SELECT style_id, count(*) AS shots, (count(*) - 1) / any_value(len) AS cps, avg(d) AS mean, quantile_cont(d, 0.5) AS med,
    quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.9) AS p90, stddev_pop(d) AS sd FROM edit GROUP BY 1""")
PACE_COLS = {"cuts_per_second": "cps", "mean_shot": "mean", "median_shot": "med", "p10_shot": "p10", "p90_shot": "p90", "shot_std": "sd"}


@query("pacing_profile", sql("SELECT style_id, shots, " + ", ".join(f"{r6(v)} AS {k}" for k, v in PACE_COLS.items()) + " FROM pace", *EDIT, PACE))
def pacing_profile(spark, sf):
    e = edit(spark, sf)
    return G.pacing_profile(e, lengths_of(e)).select("style_id", "shots", *[R(c(k)).alias(k) for k in PACE_COLS])


RHYTHM = ("rh", """SELECT style_id, CASE WHEN n < 4 THEN 'steady' WHEN sd / greatest(m, 1e-6) > 0.85 THEN 'bursty' WHEN b < a * 0.72 THEN 'accelerating'
    WHEN b > a * 1.38 THEN 'decelerating' ELSE 'steady' END AS rhythm FROM (
    SELECT style_id, count(*) AS n, stddev_pop(d) AS sd, avg(d) AS m, avg(CASE WHEN idx < n0 // 2 THEN d END) AS a, avg(CASE WHEN idx >= n0 // 2 THEN d END) AS b
    FROM (SELECT *, count(*) OVER (PARTITION BY style_id) AS n0 FROM edit) GROUP BY 1)""")


@query("rhythm_class", sql("SELECT style_id, rhythm FROM rh", *EDIT, RHYTHM))
def rhythm_class(spark, sf):
    return G.rhythm_class(edit(spark, sf))


@query("fastest_window", sql(f"""SELECT style_id, {r6('s')} AS w_start, {r6('s + 2.0')} AS w_end, k AS starts FROM (
    SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY k DESC, s) AS r FROM (
      SELECT a.style_id, a.s, count(*) AS k, any_value(a.n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY style_id) AS n FROM edit) a
      JOIN edit b ON b.style_id = a.style_id AND b.s >= a.s AND b.s < a.s + 2.0 GROUP BY 1, 2)) WHERE r = 1 AND n > 2""", *EDIT))
def fastest_window(spark, sf):
    d = G.fastest_window(edit(spark, sf), width=5.0)
    return d.select("style_id", R(c("w_start")).alias("w_start"), R(c("w_end")).alias("w_end"), "starts")


@query("duration_histogram", sql("""SELECT style_id, bin, count(CASE WHEN least(floor(d / top * 8), 7) = bin THEN 1 END) AS shots FROM (
    SELECT *, greatest(max(d) OVER (PARTITION BY style_id), 2.0) AS top FROM edit), (SELECT unnest(range(8)) AS bin) GROUP BY 1, 2""", *EDIT))
def duration_histogram(spark, sf):
    return G.duration_histogram(edit(spark, sf)).select("style_id", c("bin").cast("long").alias("bin"), "shots")


@query("sample_every", sql("""SELECT style_id, idx FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY style_id) // 4) AS step FROM edit)
    WHERE idx % step = 0 AND idx // step < 4""", *EDIT))
def sample_every(spark, sf):
    return G.sample_every(edit(spark, sf), 4).select("style_id", "idx")


LIGHT = "CASE WHEN brightness < 0.32 AND contrast > 0.35 THEN 'low_key' WHEN brightness > 0.62 THEN 'high_key' ELSE 'mid' END"
PROFILE = [
    ("lit", f"SELECT *, l_suppkey AS style_id, {LIGHT} AS light_key FROM shots"),
    ("pm", """SELECT style_id, string_agg(camera_movement || ':' || CAST(round(k / n, 4) AS VARCHAR), ',' ORDER BY k DESC, camera_movement) AS moves, arg_max(camera_movement, r) AS first_move FROM (
        SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY k DESC, camera_movement) AS rk, -row_number() OVER (PARTITION BY style_id ORDER BY k DESC, camera_movement) AS r FROM (
          SELECT style_id, camera_movement, count(*) AS k, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY style_id) AS n FROM lit) GROUP BY 1, 2)) WHERE rk <= 4 GROUP BY 1"""),
    ("pk0", """SELECT style_id, light_key FROM (SELECT style_id, light_key, row_number() OVER (PARTITION BY style_id ORDER BY count(*) DESC, light_key) AS r
        FROM lit GROUP BY 1, 2) WHERE r = 1"""),
    ("prof", """SELECT style_id, avg(flow_magnitude) AS mean_flow, var_pop(flow_magnitude) AS motion_variance, avg(zoom_rate) AS zoom_tendency, avg(shake) AS shake_level,
        avg(brightness) AS brightness, avg(contrast) AS contrast, avg(warmth) AS warmth, avg(clipped_shadows) AS black_level FROM lit GROUP BY 1"""),
]
PROFILE_COLS = ("mean_flow", "motion_variance", "zoom_tendency", "shake_level", "brightness", "contrast", "warmth", "black_level")


def _profiled(spark, sf):
    d = V.shots(spark, sf).withColumn("style_id", c("l_suppkey")).withColumn("light_key", light_key(c("brightness"), c("contrast")))
    return G.motion_color_profile(d)


@query("motion_color_profile", sql("SELECT style_id, light_key, first_move, " + ", ".join(f"{r6(x)} AS {x}" for x in PROFILE_COLS) + " FROM prof JOIN pk0 USING (style_id) JOIN pm USING (style_id)", *PROFILE))
def motion_color_profile(spark, sf):
    return _profiled(spark, sf).select("style_id", "light_key", F.get("moves", F.lit(0))["move"].alias("first_move"), *[R(c(x)).alias(x) for x in PROFILE_COLS])


KINDS = [
    ("smp", "SELECT s.series_id, s.n, s.t, score, g.v * 12 AS luma FROM score s JOIN sig g USING (series_id, n)"),
    ("bas", "SELECT series_id, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.99) AS hi, quantile_cont(luma, 0.5) AS bl FROM smp GROUP BY 1"),
    ("nr", """SELECT *, list(score) OVER w AS ls, list(luma) OVER w AS ll FROM smp WINDOW w AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""),
    ("hit", """SELECT * FROM (SELECT q.series_id, q.event_id, ls, ll, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(r.t - q.cut), r.t) AS k
        FROM (SELECT series_id, event_id, cut + 1800 AS cut FROM cuts) q JOIN nr r USING (series_id)) WHERE k = 1"""),
    ("kinds", """SELECT a.series_id, event_id, CASE WHEN len(ls) < 3 THEN 'cut'
        WHEN pos > 1 AND pos < len(ll) AND lm > greatest(ll[1], ll[-1]) * 1.35 AND lm > bl * 1.4 AND lm > 150 THEN 'flash'
        WHEN pk > hi AND pk / (sm + 1e-9) > 0.45 THEN 'whip'
        WHEN pk / (sm + 1e-9) < 0.34 AND len(list_filter(ls, lambda x: x > CASE WHEN med = 0 THEN 1e-6 ELSE med END * 1.5)) >= 4 AND pk < hi THEN 'dissolve' ELSE 'cut' END AS kind
        FROM (SELECT *, list_max(ls) AS pk, list_sum(ls) AS sm, list_max(ll) AS lm, list_position(ll, list_max(ll)) AS pos FROM hit) a JOIN bas USING (series_id)"""),
]


def _samples(spark, sf):
    from ..operators.series import change_score
    return stage(change_score(V.series(spark, sf)).select("series_id", "n", "t", "score", (c("v") * 12).alias("luma")))


def _kinds(spark, sf):
    q = V.cuts(spark, sf).withColumn("cut", c("cut") + 1800)
    return G.transition_kind(q, _samples(spark, sf))


@query("transition_kind", sql("SELECT series_id, event_id, kind FROM kinds", SCORE, *KINDS))
def transition_kind(spark, sf):
    return _kinds(spark, sf).select("series_id", "event_id", "kind")


SHARE = ("shr", """SELECT series_id, avg(CASE WHEN kind = 'cut' THEN 1.0 ELSE 0 END) AS hard_cut_share, avg(CASE WHEN kind = 'flash' THEN 1.0 ELSE 0 END) AS flash_share,
    avg(CASE WHEN kind = 'whip' THEN 1.0 ELSE 0 END) AS whip_share, avg(CASE WHEN kind = 'dissolve' THEN 1.0 ELSE 0 END) AS dissolve_share FROM kinds GROUP BY 1""")


@query("transition_shares", sql("SELECT series_id, " + ", ".join(f"{r6(x)} AS {x}" for x in G.SHARES) + ", CASE WHEN hard_cut_share = 1 THEN 0.0::DOUBLE ELSE 0.12::DOUBLE END AS mean_duration FROM shr", SCORE, *KINDS, SHARE))
def transition_shares(spark, sf):
    d = G.transition_shares(_kinds(spark, sf))
    return d.select("series_id", *[R(c(x)).alias(x) for x in G.SHARES], c("mean_transition_duration").alias("mean_duration"))


PTS = 16
CURVE = [
    ("du", "SELECT series_id, max(t) AS duration FROM sig GROUP BY 1"),
    ("gr", f"SELECT series_id, i, i * duration / {PTS - 1}.0::DOUBLE AS g, duration FROM du, (SELECT unnest(range({PTS})) AS i)"),
    ("kd", "SELECT g.series_id, i, coalesce(sum(exp(-power(g.g - c.cut, 2) / (2 * 86400.0 * 86400.0))), 0.0) AS d FROM gr g LEFT JOIN cuts c ON c.series_id = g.series_id GROUP BY 1, 2"),
    *mirror_sql("score", "score", 8, "ms"),
    ("mo", """SELECT q.series_id, q.i, CASE WHEN b.t IS NULL THEN f.smooth WHEN f.t IS NULL OR f.t = b.t THEN b.smooth ELSE b.smooth + (f.smooth - b.smooth) * (q.g - b.t) / (f.t - b.t) END AS y
        FROM gr q ASOF LEFT JOIN ms b ON b.series_id = q.series_id AND b.t <= q.g ASOF LEFT JOIN ms f ON f.series_id = q.series_id AND f.t >= q.g"""),
    ("mx", """SELECT series_id, i AS n, least(greatest(0.62 * d / CASE WHEN max(d) OVER w > 0 THEN max(d) OVER w ELSE 1 END + 0.38 * y / CASE WHEN max(y) OVER w > 0 THEN max(y) OVER w ELSE 1 END, 0), 1) AS x
        FROM kd JOIN mo USING (series_id, i) WINDOW w AS (PARTITION BY series_id)"""),
    *mirror_sql("mx", "x", 3, "cv"),
]


def curves(spark, sf):
    sig = V.raw_series(spark, sf)
    dur = sig.groupBy("series_id").agg(F.max("t").alias("duration"))
    return G.intensity_curve(V.cuts(spark, sf), _samples(spark, sf), dur, PTS, start="cut", sigma=86400.0)


@query("intensity_curve", sql(f"SELECT series_id, n AS i, {r6('smooth')} AS value FROM cv", SCORE, *CURVE))
def intensity_curve(spark, sf):
    d = curves(spark, sf).select("series_id", F.posexplode("curve").alias("i", "value"))
    return d.select("series_id", c("i").cast("long").alias("i"), R(c("value")).alias("value"))


ARC = [ENDS, ("pk1", f"""SELECT series_id, any_value(len) AS dur, arg_max(n, x) * any_value(len) / {PTS - 1}.0 AS peak FROM (SELECT series_id, n, round(smooth, 9) - n * 1e-12 AS x FROM cv) JOIN ends USING (series_id) GROUP BY 1"""),
       ("pk2", "SELECT *, least(dur * 0.15, 2.0) AS hook, least(dur, peak + greatest(1.0, dur * 0.2)) AS ce FROM pk1"),
       ("arc", """SELECT series_id, 'hook' AS role, 0.0 AS s, hook AS e FROM pk2 UNION ALL
        SELECT series_id, 'setup', hook, hook + (peak - hook) * 0.45 FROM pk2 WHERE peak > hook + 0.5 UNION ALL
        SELECT series_id, 'escalation', CASE WHEN peak > hook + 0.5 THEN hook + (peak - hook) * 0.45 ELSE hook END, CASE WHEN peak > hook + 0.5 THEN peak ELSE greatest(hook + 0.5, peak) END FROM pk2 UNION ALL
        SELECT series_id, 'climax', CASE WHEN peak > hook + 0.5 THEN peak ELSE greatest(peak, greatest(hook + 0.5, peak)) END, ce FROM pk2 UNION ALL
        SELECT series_id, 'release', ce, dur FROM pk2 WHERE ce < dur - 0.2""")]


@query("segment_structure", sql(f"SELECT series_id, role, {r6('s')} AS seg_start, {r6('e')} AS seg_end FROM arc WHERE e > s + 0.05", SCORE, *CURVE, *ARC))
def segment_structure(spark, sf):
    cv = curves(spark, sf).drop("duration").join(ends(spark, sf), "series_id").withColumn("curve", F.transform("curve", lambda x, i: F.round(x, 9) - i * 1e-12))
    d = G.segment_structure(cv).select("series_id", F.inline_outer("structure"))
    return d.filter("role IS NOT NULL").select("series_id", "role", R(c("start")).alias("seg_start"), R(c("end")).alias("seg_end"))


@query("beat_sync", sql(f"""SELECT series_id, {r6('least(greatest(1 - avg(abs(nb - cut)) / 86400.0, 0), 1)')} AS beat_sync FROM (
    SELECT c.series_id, c.event_id, c.cut, arg_min(b.beat, abs(b.beat - c.cut)) AS nb FROM cuts c JOIN beats b USING (series_id) GROUP BY 1, 2, 3) GROUP BY 1"""))
def beat_sync(spark, sf):
    d = G.beat_sync_strength(V.cuts(spark, sf), V.beats(spark, sf), start="cut", scale=86400.0)
    return d.select("series_id", R(c("beat_sync")).alias("beat_sync"))


@query("effect_density", sql(f"SELECT style_id, {r6('least(greatest(0.5 * (1 - brightness) + 0.5 * least(1.0, motion_variance / 2.0), 0), 1)')} AS density FROM prof", *PROFILE[:1], PROFILE[3]))
def effect_density(spark, sf):
    return _profiled(spark, sf).select("style_id", R(G.effect_density(c("brightness"), c("motion_variance"))).alias("density"))


TARGET = "hi - (hi - lo) * least(greatest(inten, 0), 1)"


@query("target_shot_duration", sql(f"""SELECT shot_id, {r6('inten')} AS intensity, {r6(TARGET)} AS target FROM (SELECT *, greatest(lo + 0.05, hi0) AS hi FROM (
    SELECT shot_id, [0.1, 0.4, 0.9, 0.6, 0.2][CAST(floor(least(greatest(warmth, 0), 1) * 4) AS INT) + 1]::DOUBLE AS inten, greatest(0.12, CASE WHEN noise = 0 THEN 0.3 ELSE noise END * greatest(0.35, duration / 3)) AS lo,
      CASE WHEN shake = 0 THEN 1.2 ELSE shake END * greatest(0.35, duration / 3) AS hi0 FROM shots))"""))
def target_shot_duration(spark, sf):
    curve = F.array(*[F.lit(x) for x in (0.1, 0.4, 0.9, 0.6, 0.2)])
    d = V.shots(spark, sf).withColumn("intensity", G.intensity_at(curve, c("warmth")))
    t = G.target_shot_duration(c("intensity"), c("noise"), c("shake"), c("duration") / 3)
    return d.select("shot_id", R(c("intensity")).alias("intensity"), R(t).alias("target"))


BLEND_MEANS = ("cuts_per_second", "mean_shot", "median_shot", "p10_shot", "p90_shot", "shot_std", "mean_flow", "motion_variance", *G.SHARES)


def styles(spark, sf):
    """One style per series: measured pacing and rhythm, remaining fields made from the key."""
    e = edit(spark, sf)
    d = G.pacing_profile(e, lengths_of(e)).join(G.rhythm_class(e), "style_id")
    k = c("style_id")
    n = F.when(k % 2 == 0, 8).otherwise(16)
    return d.withColumns({
        "label": F.concat(F.lit("Style No. "), k.cast("string")), "version": F.when(k % 13 == 0, "0.9.0").otherwise(G.GRAMMAR_VERSION),
        "mean_flow": (k % 7) / 2.0, "motion_variance": (k % 5) / 3.0, "hard_cut_share": (k % 4) / 8.0 + 0.2, "flash_share": (k % 3) / 10.0,
        "whip_share": (k % 5) / 20.0, "dissolve_share": (k % 6) / 15.0,
        "light_key": F.when(k % 3 == 0, "low_key").when(k % 3 == 1, "mid").otherwise("high_key"),
        "intensity_curve": F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i * 7 + k) % 11) / 10.0),
        "moves": F.array(F.struct(F.when(k % 2 == 0, "static").otherwise("pan_left").alias("move"), F.lit(0.6).alias("share")), F.struct(F.lit("complex").alias("move"), F.lit(0.4).alias("share"))),
        "saved_at": k})


STYLE = ("sty", """SELECT p.style_id, cps AS cuts_per_second, mean AS mean_shot, med AS median_shot, p10 AS p10_shot, p90 AS p90_shot, sd AS shot_std, rhythm,
    'Style No. ' || CAST(style_id AS VARCHAR) AS label, CASE WHEN style_id % 13 = 0 THEN '0.9.0' ELSE '1.0.0' END AS version,
    (style_id % 7) / 2.0 AS mean_flow, (style_id % 5) / 3.0 AS motion_variance, (style_id % 4) / 8.0 + 0.2 AS hard_cut_share, (style_id % 3) / 10.0 AS flash_share,
    (style_id % 5) / 20.0 AS whip_share, (style_id % 6) / 15.0 AS dissolve_share, CASE style_id % 3 WHEN 0 THEN 'low_key' WHEN 1 THEN 'mid' ELSE 'high_key' END AS light_key,
    style_id // 10 AS blend_id, CAST(style_id % 4 AS DOUBLE) AS weight, CASE WHEN style_id % 2 = 0 THEN 8 ELSE 16 END AS n FROM pace p JOIN rh USING (style_id)""")
OKSTY = ("ok", "SELECT * FROM sty WHERE version = '1.0.0' AND weight > 0")
_sh = " + ".join(f"sum({s} * weight)" for s in G.SHARES)


@query("blend_styles", sql("SELECT b.*, rhythm, rhythm_disagreed, light_key FROM (SELECT blend_id, count(*) AS sources, " + ", ".join(
    f"{r6(f'sum({m} * weight) / sum(weight)')} AS {m}" for m in BLEND_MEANS if m not in G.SHARES) + ", " + ", ".join(
    f"{r6(f'CASE WHEN count(*) = 1 THEN max({s}) ELSE sum({s} * weight) / ({_sh}) END')} AS {s}" for s in G.SHARES) + """ FROM ok GROUP BY 1) b
    JOIN (SELECT blend_id, rhythm, k > 1 AS rhythm_disagreed FROM (SELECT *, row_number() OVER (PARTITION BY blend_id ORDER BY v DESC, mw DESC, ms) AS r, count(*) OVER (PARTITION BY blend_id) AS k FROM (
      SELECT blend_id, rhythm, sum(weight) AS v, max(weight) AS mw, arg_max(style_id, weight - style_id * 1e-6) AS ms FROM ok GROUP BY 1, 2)) WHERE r = 1) USING (blend_id)
    JOIN (SELECT blend_id, light_key FROM (SELECT *, row_number() OVER (PARTITION BY blend_id ORDER BY v DESC, mw DESC, ms) AS r FROM (
      SELECT blend_id, light_key, sum(weight) AS v, max(weight) AS mw, arg_max(style_id, weight - style_id * 1e-6) AS ms FROM ok GROUP BY 1, 2)) WHERE r = 1) USING (blend_id)""", *EDIT, PACE, RHYTHM, STYLE, OKSTY))
def blend_styles(spark, sf):
    ok, _ = G.version_gate(styles(spark, sf))
    w = ok.select(F.floor(c("style_id") / 10).cast("long").alias("blend_id"), "style_id", (c("style_id") % 4).cast("double").alias("weight"))
    d = G.blend_styles(ok, w, BLEND_MEANS)
    return d.select("blend_id", "sources", "rhythm", "rhythm_disagreed", "light_key", *[R(c(m)).alias(m) for m in BLEND_MEANS])


@query("blend_curves", sql(f"""SELECT blend_id, i, {r6('sum(weight * (a * (1 - f) + b * f)) / sum(weight)')} AS value FROM (SELECT *, ((lo * 7 + style_id) % 11) / 10.0 AS a, ((least(lo + 1, n - 1) * 7 + style_id) % 11) / 10.0 AS b FROM (
    SELECT *, CAST(floor(i * (n - 1) / (m - 1.0::DOUBLE)) AS BIGINT) AS lo, i * (n - 1) / (m - 1.0::DOUBLE) - floor(i * (n - 1) / (m - 1.0::DOUBLE)) AS f FROM (
      SELECT *, unnest(range(m)) AS i FROM (SELECT *, max(n) OVER (PARTITION BY blend_id) AS m FROM ok)))) GROUP BY 1, 2""", *EDIT, PACE, RHYTHM, STYLE, OKSTY))
def blend_curves(spark, sf):
    ok, _ = G.version_gate(styles(spark, sf))
    w = ok.select(F.floor(c("style_id") / 10).cast("long").alias("blend_id"), "style_id", (c("style_id") % 4).cast("double").alias("weight"))
    d = G.blend_styles(ok, w, ("mean_shot",)).select("blend_id", F.posexplode("intensity_curve").alias("i", "value"))
    return d.select("blend_id", c("i").cast("long").alias("i"), R(c("value")).alias("value"))


@query("version_gate", sql("SELECT style_id, version FROM sty WHERE version <> '1.0.0'", *EDIT, PACE, RHYTHM, STYLE))
def version_gate(spark, sf):
    return G.version_gate(styles(spark, sf))[1].select("style_id", "version")


@query("style_table", sql("""SELECT 'style-no-' || CAST(style_id AS VARCHAR) AS slug, rhythm, 'style-no-' || CAST(style_id AS VARCHAR) || printf(': %.2f cuts/s', cuts_per_second) AS summary
    FROM sty WHERE style_id % 5 <> 0""", *EDIT, PACE, RHYTHM, STYLE))
def style_table(spark, sf):
    s = styles(spark, sf)
    old = G.save_styles(s.withColumn("slug", G.slug(c("label"))).filter("style_id % 2 = 0").withColumn("rhythm", F.lit("stale")), s.withColumn("source_path", F.lit("/secret")))
    kept = G.delete_styles(old, s.filter("style_id % 5 = 0").select("label"))
    if "source_path" in kept.columns:
        raise AssertionError("a stored style names its source")
    text = F.format_string("%s: %.2f cuts/s", "slug", "cuts_per_second")
    return kept.join(G.describe_styles(kept).select("slug"), "slug").select("slug", "rhythm", text.alias("summary"))
